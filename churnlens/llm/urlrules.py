"""URL verdicts by listed rules, then by association rules that FP-growth mines from labelled URLs.

A URL is the set of its tokens (scheme, host labels, path segments with numbers masked, query parts, fragment).
FP-growth finds the token combinations that labelled URLs share; those that imply "block" with enough support
and confidence, and by a rate whose lower confidence limit lies above the rate of all labelled URLs, are the rules,
less every rule that contains a shorter one.  Each rule is filed under its rarest
token, so a URL only meets the rules filed under a token it has.  DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import stored

# The listed rules (verdict, host and path prefix), from the query's contract.
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
          ("block", "net/fr/"))
#: Least number of labelled URLs that a rule's tokens and "block" share, whatever the size of the input.
MIN_COUNT = 5
#: Least share of blocked URLs among those that have a rule's tokens.
MIN_CONFIDENCE = 0.6
#: Standard errors of the lower confidence limit (Wilson) of that share; many combinations are tried, so it is far out.
DEVIATIONS = 4.0
_BLOCK = "!block"


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host (A-Z lower-cased), path, query and fragment; all empty without a ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    parts = {"scheme": F.when(at > 0, F.substring_index(url, "://", 1)).otherwise(""),
             "host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase), "path": path,
             "query": F.regexp_extract(F.substr(tail, F.length(path) + 1), r"^\?([^#]*)", 1),
             "fragment": F.regexp_extract(tail, r"#([\s\S]*)$", 1)}
    return {k: F.coalesce(v, F.lit("")) for k, v in parts.items()}


def url_tokens(url: Column) -> Column:
    """The sorted set of a URL's tokens."""
    p = url_parts(url)

    def some(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(mark), v))

    masked = F.regexp_replace(p["path"], "[0-9]+", "#")
    return F.array_sort(F.array_distinct(F.concat(
        some("s:", F.array(p["scheme"])), some("h:", F.split(p["host"], r"\.")), some("p:", F.split(masked, "/")),
        some("q:", F.split(p["query"], "&")), some("f:", F.array(p["fragment"])))))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule whose host is the URL's or above it and whose path begins its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _holding(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a token set (tokens) and a rule (antecedent, anchor) that it contains, by inverted index."""
    return (sets.withColumn("anchor", F.explode("tokens")).join(rules, "anchor")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0))


def lower_limit(hits: Column, tries: Column, deviations: float = DEVIATIONS) -> Column:
    """Lower limit (Wilson) of the rate behind ``hits`` of ``tries``."""
    rate, z2 = hits / tries, deviations * deviations
    spread = deviations * F.sqrt(rate * (1 - rate) / tries + z2 / (4 * tries * tries))
    return (rate + z2 / (2 * tries) - spread) / (1 + z2 / tries)


def mine_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
               deviations: float = DEVIATIONS) -> DataFrame:
    """(url, blocked boolean) -> antecedent (sorted tokens), anchor, support, confidence of the shortest rules.

    A rule needs ``min_count`` blocked rows, ``min_confidence`` and a lower limit of its rate above the rate of all
    rows: combinations that are blocked as often as chance has it are no rules.

    All labelled rows count, repeated ones too; rows with a null label are left out; without rows no rules.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where("blocked IS NOT NULL").select(
        url_tokens(F.col("url")).alias("tokens"), "blocked").select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens"))
        .alias("items")), "url-baskets")
    n, blocked = rows.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", _BLOCK))).first()
    if not n:
        return spark.createDataFrame([], "antecedent array<string>, anchor string, support double, confidence double")
    share = (min_count - 0.5) / n
    sets = stored(FPGrowth(itemsCol="items", minSupport=min(1.0, share)).fit(rows).freqItemsets
                  .select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    both = (sets.where(F.array_contains("items", _BLOCK) & (F.size("items") > 1))
            .select(F.array_remove("items", _BLOCK).alias("items"), F.col("freq").alias("both")))
    hits, tries = F.col("both").cast("double"), F.col("freq").cast("double")
    rules = stored(sets.join(both, "items").where(
        (hits / tries >= min_confidence) & (lower_limit(hits, tries, deviations) > blocked / n))
                   .select(F.col("items").alias("antecedent"), (F.col("both") / n).alias("support"),
                           (F.col("both") / F.col("freq")).alias("confidence")), "url-rules")
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("uses"))
    rarest = (rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token")
              .groupBy("antecedent").agg(F.min(F.struct("uses", "token")).alias("r"))
              .select("antecedent", F.col("r.token").alias("anchor")))
    filed = stored(rules.join(rarest, "antecedent"), "url-rules-filed")
    longer = (_holding(filed.select(F.col("antecedent").alias("tokens")), filed.select("antecedent", "anchor"))
              .where("tokens <> antecedent").select(F.col("tokens").alias("antecedent")).distinct())
    return stored(filed.join(longer, "antecedent", "left_anti").select("antecedent", "anchor", "support", "confidence"),
                  "url-rules-shortest")


def judge_urls(pages: DataFrame, rules: DataFrame, listed=LISTED) -> DataFrame:
    """pages (url, ...) -> its columns, host, path, rule, verdict: allow or block.

    A listed rule decides first; else a URL that holds a mined rule is blocked, any other allowed.  A null URL or
    one without ``://`` has empty host and path and no tokens: allowed.  One row per row, repeated rows included;
    an empty table gives no rows; columns named like the added ones are replaced.  Mined rules are matched once
    per different token set, so a host of any weight is no hot key of the match.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = url_parts(F.col("url"))
    rows = pages.select(*own, parts["host"].alias("host"), parts["path"].alias("path"),
                        url_tokens(F.col("url")).alias("_tokens"))
    blocked = stored(_holding(rows.select(F.col("_tokens").alias("tokens")).distinct(),
                              rules.select("antecedent", "anchor"))
                     .select(F.col("tokens").alias("_held")).distinct(), "url-blocked")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    return (rows.join(blocked, F.col("_tokens") == F.col("_held"), "left")
            .select(*own, "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("_held").isNotNull(), "block").otherwise("allow"))
                    .alias("verdict")))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages whose path ends in the number of a labelled document.

    A document is to be blocked if a label calls it toxic (1) or of low quality (0); labels with neither are left out.
    A number that no 64-bit integer holds names no document.
    """
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    docs = stored(labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)")
                  .groupBy("doc_id").agg(F.max(bad).alias("blocked")), "url-labels")
    number = F.regexp_extract(url_parts(F.col("url"))["path"], r"/([0-9]+)(?:[./][^/]*)?$", 1)
    return (pages.select("url", number.try_cast("long").alias("doc_id"))
            .where("doc_id IS NOT NULL").join(docs, "doc_id").select("url", "blocked"))
