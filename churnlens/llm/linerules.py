"""Quality rules, lines first: every line is judged, failing lines go, then documents that lose too much text.

A line fails by one of three rules.  Punctuation: it neither ends in a closing mark nor holds one before a blank, or
it is shouted in runs of marks.  Navigation: it is a menu, a list of short entries between separators, or one of the
words of a menu.  Boilerplate: it holds a phrase of notices, consent banners or licence lines.  A document is
rejected if it fails the base figures (too few words, too much repetition) or if the failing lines hold more than
``MOST_LOST`` per cent of its characters.

DataFrame functions only, and no shuffle: the lines and the three-word windows of a document stay in arrays of its
row, so a group of equal documents or a frequent line costs nothing beyond its rows.  Windows are sorted inside the
row and compared with their neighbours, which is n log n for a text of n words.  Each step is a projection of its
own, so that an array is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import WORD, quoted

#: Least words, and most per cent of words in repeated windows (fixed by the operator's contract).
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Most per cent of the characters (in words) that failing lines may hold.
MOST_LOST = 30
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"

#: Marks that close a sentence, with what may follow them before the next blank or the line's end.
CLOSED = r"[.!?;:…。！？；：؟۔।][\])}\"'”’»›]*([\x20\x09-\x0D]|\z)"
#: Doubled marks, and separators that stand alone; a line with ``MOST_MARKS`` of either is shouted or a list of entries.
DOUBLED = r"[!?]{2,}"
SEPARATOR = r"[\x20\x09][|»›>•·→][\x20\x09]"
MOST_MARKS = 3
#: A line that is nothing but the text of a link in a menu.
MENU = (r"(?i)^[\x20\x09-\x0D]*(home|menu|search|login|log in|sign in|sign up|register|contact|contact us|about|"
        r"about us|sitemap|site map|skip to content|next|next page|previous|previous page|read more|more|share|"
        r"print|back|back to top|top|subscribe|follow us)[\x20\x09-\x0D]*[.:>»›]*[\x20\x09-\x0D]*\z")
BOILERPLATE = (r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|(use|uses) cookies|"
               r"accept cookies|enable javascript|lorem ipsum|subscribe to our newsletter|powered by |"
               r"click here to |licensed under |released under the |©|\(c\) *[0-9]{4})")


def _chars(text: Column) -> Column:
    """Code points of a text in words, that is, without ASCII blanks."""
    return F.length(F.translate(text, _BLANKS, ""))


def line_fails(line: Column) -> Column:
    """Whether one line fails the punctuation, the navigation or the boilerplate rule."""
    return (~F.rlike(line, F.lit(CLOSED)) | (F.regexp_count(line, F.lit(DOUBLED)) >= MOST_MARKS)
            | (F.regexp_count(line, F.lit(SEPARATOR)) >= MOST_MARKS)
            | F.rlike(line, F.lit(MENU)) | F.rlike(line, F.lit(BOILERPLATE)))


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds ``repeated``: the words of each row's ``words`` in three-word windows that occur twice or more."""
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(
        F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.cast("int").alias("i")))
    docs = docs.withColumn("windows", F.sort_array(windows)).drop("words")
    same = F.filter("windows", lambda x, j: x["w"].eqNullSafe(F.get("windows", j - 1)["w"])
                    | x["w"].eqNullSafe(F.get("windows", j + 1)["w"]))
    docs = docs.withColumn("starts", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("windows")
    # a window covers its own word and the two after it; neighbours share words
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    return docs.withColumn("repeated", covered).drop("starts")


def judge(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    n_failed_lines, lost_chars.

    One row per row, repeated ids too.  A null or empty text has no word: all figures are 0, ``base_failed``.  Lines
    without a word neither fail nor count.  Other columns of ``docs`` do not enter; a null id stays null.
    """
    t = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", t.alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"))
    figures = parts.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), _chars(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", line_fails).alias("failed"))
    figures = figures.withColumns({
        "n_failed_lines": F.size("failed").cast("long"),
        "lost_chars": F.aggregate("failed", F.lit(0).cast("long"), lambda a, x: a + _chars(x))}).drop("failed")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("repeated") > MOST_REPEATED * F.col("n_words"))
    return _repeated_words(figures).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("repeated").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))).alias("kept"),
        "n_failed_lines", "lost_chars")


def cleaned(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """The kept documents with their own columns, ``text`` without its failing lines (blank lines stay).

    The other columns come back unchanged, whatever their names: they travel in one struct.
    """
    text = F.coalesce("own.text", F.lit(""))
    verdicts = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("own"))
    judged = judge_columns(verdicts, text, most_lost)
    clean = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.rlike(x, F.lit(WORD)) | ~line_fails(x)), "\n")
    kept = judged.where("kept").select("own", clean.alias("clean"))
    return kept.select(*[(F.col("clean") if c == "text" else F.col("own").getField(c)).alias(c) for c in docs.columns])


def judge_columns(rows: DataFrame, text: Column, most_lost: int) -> DataFrame:
    """Rows of one struct ``own`` with the verdict ``kept`` for its text: ``judge`` with the row in place of the id."""
    return judge(rows.select(F.col("own").alias("doc_id"), text.alias("text")), most_lost).withColumnRenamed("doc_id", "own")
