"""Collocations per language by top-order marginalisation.

Every word starts one window of itself and the next three words of its piece, padded behind the piece's end, as four
lead columns.  Only these longest windows are counted; ``ROLLUP`` over the lead columns sums them into the counts of
all shorter phrases, because a phrase occurs as often as windows begin with it, and into the number of words of a
language.  No shorter n-gram is ever exploded.

Before counting, windows are shortened to what can matter: a phrase of 30 occurrences has only words, pairs and
triples of 30 occurrences.  These are counted by a hash of 40 bits; hashes that reach the least count are marked in a
table of bits, 16 bits a hash and at most 32 MB.  A window ends before its first pair or triple, and is all padding
from a word, that is not marked.  A shortened window still counts in all its prefixes, and what is cut off occurs
fewer than 30 times, so every kept count is exact; hashes or bits that collide only leave windows longer than needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.bytewords import Words, cut, slices
from churnlens.llm.common import drop_stored, stored, workers_find_package

UNKNOWN = "und"
ORDER = 4
LEADS = [f"w{i}" for i in range(1, ORDER + 1)]
#: Fixed by the operator's contract.
LEAST_COUNT = 30
KEPT = 2000
SCALE = 2_000_000
SUBSUMED = 80

#: Bits of a word's or pair's hash; bits of the table for each frequent hash, and of the whole table at most.
HASH_BITS = 40
BITS_EACH = 16
MOST_BITS = 1 << 28
#: Parts that the table is made in.
PARTS = 64

_BREAKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_BLANKS = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _language_hashes(langs: pa.Array) -> np.ndarray:
    names = langs.dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names.dictionary.to_pylist()], np.uint64)
    return seeds[names.indices.to_numpy()]


def _hashes(words: Words, langs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and triples: the hash of the one that begins at each word, and whether its piece holds it."""
    n, shift = len(words.codes), np.uint64(64 - HASH_BITS)
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(0, bool))] * 3
    of_word = np.array([xxhash.xxh64_intdigest(x.encode()) for x in words.vocabulary.to_pylist()], np.uint64)[words.codes]
    state, out = of_word ^ langs[words.rows], []
    for k, mix in enumerate(_MIX):
        if k:
            state[:max(0, n - k)] ^= of_word[k:] >> np.uint64(7)
        state *= mix
        held = np.zeros(n, bool)
        held[:max(0, n - k)] = words.pieces[k:] == words.pieces[:max(0, n - k)]
        out.append(((state >> shift).astype(np.int64), held))
    return out


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Words]]:
    for a, b in slices(batch.column(1)):
        langs = pc.fill_null(batch.column(0).slice(a, b - a), UNKNOWN)
        yield langs, cut(batch.column(1).slice(a, b - a), _BLANKS, _BREAKS)


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, words in _sliced(batch):
            found = _hashes(words, _language_hashes(langs))
            hashes, times = np.unique(np.concatenate([h[held] for h, held in found]), return_counts=True)
            yield pa.record_batch([pa.array(hashes), pa.array(times.astype(np.int64))], ["hash", "n"])


def _mark_task(size: int):
    def task(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(size // PARTS, bool)
        for batch in batches:
            marked[batch.column(batch.schema.get_field_index("at")).to_numpy()] = True
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(marked).tobytes()], pa.binary())],
                              ["part", "bits"])
    return task


def _frequent_bits(docs: DataFrame, least: int) -> np.ndarray:
    """A bit per slot: whether a word, pair or triple whose hash falls there may occur ``least`` times (at most 32 MB)."""
    hashes = docs.mapInArrow(_hash_task, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = stored(hashes.select("hash"), "frequent-hashes")
    size = max(1 << 16, min(MOST_BITS, 1 << (BITS_EACH * frequent.count()).bit_length()))
    slot = F.col("hash") % size
    rows = (frequent.select((slot % PARTS).cast("int").alias("part"), F.expr(f"hash % {size} div {PARTS}").alias("at"))
            .distinct().groupBy("part").applyInArrow(_mark_task(size), "part int, bits binary").collect())
    bits = np.zeros((PARTS, size // PARTS // 8), np.uint8)
    for r in rows:
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    drop_stored(frequent)
    return bits


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, part = np.divmod(hashes % (bits.size * 8), PARTS)
    return (bits[part, at >> 3] >> (7 - (at & 7))) & 1 == 1


def _unique_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the different rows of non-negative columns, and how often each occurs."""
    group = columns[0]
    for c in columns[1:]:
        _, group = np.unique(group * np.int64(c.max(initial=0) + 1) + c, return_inverse=True)
    _, first, times = np.unique(group, return_index=True, return_counts=True)
    return first, times


def _window_task(bits: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, words in _sliced(batch):
                if not len(words.codes):
                    continue
                word, pair, triple = (held & _marked(bits, h) for h, held in _hashes(words, _language_hashes(langs)))
                names = langs.dictionary_encode()
                padding, n = len(words.vocabulary), len(words.codes)
                keep, leads = word, []
                # the k-th word stays if the phrase that it ends, of three words at most, can be frequent
                for k, (ends, begin) in enumerate([(word, 0), (pair, 0), (triple, 0), (triple, 1)]):
                    held = np.zeros(n, bool)
                    held[:max(0, n - begin)] = ends[begin:]
                    keep = keep & held
                    lead = np.full(n, padding, np.int64)
                    lead[:max(0, n - k)] = words.codes[k:]
                    leads.append(np.where(keep, lead, padding))
                first, times = _unique_rows([names.indices.to_numpy()[words.rows].astype(np.int64), *leads])
                padded = pa.concat_arrays([words.vocabulary, pa.array([""])])
                yield pa.record_batch([names.dictionary.take(names.indices.take(pa.array(words.rows[first]))),
                                       *[padded.take(pa.array(x[first])) for x in leads], pa.array(times.astype(np.int64))],
                                      ["lang", *LEADS, "n"])
    return task


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, text) -> lang, size, phrase, f: every phrase of 1 to 4 words with f >= least, and size 0 with all words.

    f counts all occurrences within pieces, overlapping ones too.  Null lang is ``und``, null text empty.
    """
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    windows = rows.mapInArrow(_window_task(_frequent_bits(rows, least)), "lang string, " + ", ".join(f"{w} string" for w in LEADS)
                              + ", n long")
    longest = windows.groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    level = F.grouping_id()  # a bit per column that is summed over
    sums = longest.rollup("lang", *LEADS).agg(F.sum("n").alias("f"), level.alias("g"))
    # levels: all lead columns summed over (words of the language), or a prefix whose last column is no padding
    last = [F.when(F.col("g") == (1 << (ORDER - k)) - 1, F.struct(F.lit(k).alias("size"), (F.col(LEADS[k - 1]) if k else F.lit("x")).alias("w")))
            for k in range(ORDER + 1)]
    kept = sums.withColumn("last", F.coalesce(*last)).where("last.w <> ''")
    return kept.where((F.col("last.size") == 0) | (F.col("f") >= least)).select(
        "lang", F.col("last.size").alias("size"),
        F.concat_ws(" ", *[F.when(F.col("last.size") > i, F.col(w)) for i, w in enumerate(LEADS)]).alias("phrase"), "f")


def _exact(n: Column) -> Column:
    return n.cast("decimal(20,0)")


def _cut_scores(phrases: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every phrase of two words and more: lang, phrase, a, l, r, score."""
    words = F.split("phrase", " ", -1)
    cuts = (phrases.where("size >= 2").withColumn("words", words)
            .select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail")))
    f = phrases.where("size between 1 and 3")
    heads = f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # Spark's div of decimals is the exact floor of the quotient
    scored = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
              .withColumns({"over": _exact(F.col("a")) * SCALE, "under": _exact(F.col("l")) + _exact(F.col("r"))})
              .withColumn("score", F.expr("over div under")))
    return (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
            .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score"))


def _subsumed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer phrase that holds a phrase's words in a row."""
    size = F.col("size")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    return (phrases.where("size >= 3").withColumn("words", F.split("phrase", " ", -1))
            .select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, kept: int = KEPT) -> DataFrame:
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score: the ``kept`` best phrases of each language.

    Candidates are phrases of 2 to 4 words with a = f(phrase) >= least; the lowest of their cuts' scores
    floor(2000000 a / (l + r)) counts (ties to the shortest first part).  A candidate inside a longer one with at
    least 80 % of its count is dropped.  Order: score and a descending, phrase ascending by UTF-8 bytes.  Null lang
    is ``und``, null text empty; repeated rows count each time; an empty table, or no candidate, gives no rows.
    Other columns do not enter.  A language's ranking keeps ``kept`` rows a task before they meet.
    """
    phrases = stored(phrase_counts(docs, least), "phrase-counts")
    best = _cut_scores(phrases).join(_subsumed(phrases), ["lang", "phrase"], "left")
    free = best.where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * SUBSUMED))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    words = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    out = stored(top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_stored(phrases)
    return out
