"""Ranked lexical search: the k best documents of each item by an integer term-weight score, through norm buckets.

A document's impact vector holds w * ((10^9 tf) div (1000 tf + 12 m)) for every term that the items know; an item's
vector holds how often it has each term, and the score is their inner product.  Impact vectors are ordered by
length and taken in buckets.  An item skips a bucket if the bound of Cauchy and Schwarz, its own length times the
bucket's greatest, is below the item's k-th score so far.  Inside a bucket the item's heaviest coordinates (its focus)
are multiplied out, and the rest is bounded coordinate by coordinate by the bucket's maxima and, again by Cauchy
and Schwarz, by the remaining lengths; only documents whose bound reaches the k-th score are rescored, in integers.
A bound equal to the k-th score is rescored too, so ties are exact.

Two passes over the table: one cuts the texts and stores term numbers and counts (no text is shuffled), one orders the
vectors of documents that hold a term by length (range sort, a hash of the row splits equal lengths).  The
longest vectors, a bounded number, give every item a first k-th score; a task then keeps its own k best of each
item.  Items are taken in blocks with a bounded number of terms, so what is sent to the tasks is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from churnlens.llm.bytewords import cut, slices
from churnlens.llm.common import drop_stored, stored, workers_find_package

#: Terms (with repeats) of the items that are ranked in one pass; sent to all tasks. An item with more is a block alone.
BLOCK_TERMS = 100_000
BLOCK_ITEMS = 1000
#: Longest vectors, which give the items their first scores.
FIRST = 4096
#: Vectors of a bucket, at most, and entries of its dense table.
BUCKET = 1024
BUCKET_ENTRIES = 1 << 23
#: Coordinates of an item that are multiplied out before bounds decide.
FOCUS = 8

_BREAKS = np.zeros(256, bool)
#: Bytes outside terms: ASCII but for digits and letters (fixed by the operator's contract).
_BLANKS = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])


def _in_blocks(items: DataFrame) -> DataFrame:
    """One row per item id, with the block it is ranked in (by hash, so that blocks hold about BLOCK_TERMS terms)."""
    one = items.select("item_id", "text").groupBy("item_id").agg(F.min("text").alias("text")).where(F.col("text").isNotNull())
    # a text of n characters has n / 2 terms at most
    size = one.agg(F.sum(F.length("text") / 2 + BLOCK_TERMS / BLOCK_ITEMS)).first()[0] or 0
    return one.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(size / BLOCK_TERMS)))))


class Items:
    """The items of a block: their vectors over the block's terms."""

    def __init__(self, rows: list[Row]):
        texts = pa.array([r["text"] for r in rows], pa.string())
        words = cut(texts, _BLANKS, _BREAKS)
        self.terms = words.vocabulary
        self.ids = [r["item_id"] for r in rows]
        keys, times = np.unique(words.rows * max(1, len(self.terms)) + words.codes, return_counts=True)
        of, term = np.divmod(keys, max(1, len(self.terms)))
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        self.vectors = [(term[a:b], times[a:b].astype(np.int64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _count_task(terms: pa.Array):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = cut(batch.column(1).slice(a, b - a), _BLANKS, _BREAKS)
                sizes = np.bincount(words.rows, minlength=b - a)
                known = pc.fill_null(pc.index_in(words.vocabulary, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = known[words.codes] if len(known) else np.zeros(0, np.int64)
                hit = number >= 0
                keys, times = np.unique(words.rows[hit] * max(1, len(terms)) + number[hit], return_counts=True)
                of, term = np.divmod(keys, max(1, len(terms)))
                has = np.flatnonzero(sizes)  # documents without a term do not count
                cuts = np.r_[np.searchsorted(of, has), len(of)].astype(np.int32)
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a).take(pa.array(has)), pa.array(sizes[has].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64)))], ["doc_id", "n", "terms", "tf"])
    return task


def _impact_task(weights: np.ndarray, total: int, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, tf = b.column(1).to_numpy(), b.column(2), b.column(3)
            cuts = terms.offsets.to_numpy()
            t, f = terms.values.to_numpy()[cuts[0]:cuts[-1]], tf.values.to_numpy()[tf.offsets[0].as_py():tf.offsets[-1].as_py()]
            cuts = cuts - cuts[0]
            m = 100 - 25 + (25 * n * total) // size
            of = np.repeat(np.arange(len(n)), np.diff(cuts))
            impact = weights[t] * ((1_000_000_000 * f) // (1000 * f + 12 * m[of]))
            length = np.sqrt(np.bincount(of, impact.astype(np.float64) ** 2, len(n))) * (1 + 1e-9)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (t, impact)]
            yield pa.record_batch([b.column(0), pa.array(length), *lists], ["doc_id", "length", "terms", "impact"])
    return task


class _Best:
    """The k best documents of one item seen so far."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.score, self.doc = np.r_[self.score, score], np.r_[self.doc, doc]
        self.null = np.r_[self.null, null]
        top = np.lexsort((self.doc, self.null, -self.score))[:self.k]
        self.score, self.doc, self.null = self.score[top], self.doc[top], self.null[top]
        if len(top) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def search_bucket(items: Items, strength: np.ndarray, best: list[_Best], doc: np.ndarray, null: np.ndarray,
                  length: np.ndarray, cuts: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> int:
    """Rank a bucket's vectors (doc, length; terms and impacts from cut to cut) for all items; how many were rescored."""
    reach = strength * length.max(initial=0)
    live = [i for i in range(len(best)) if reach[i] >= best[i].floor]
    if not live or not len(terms):
        return 0
    here, column = np.unique(terms, return_inverse=True)
    table = np.zeros((len(here), len(doc)), np.int64)
    table[column, np.repeat(np.arange(len(doc)), np.diff(cuts))] = impact
    most = table.max(axis=1)
    rescored = 0
    for i in live:
        t, times = items.vectors[i]
        at = np.searchsorted(here, t)
        ok = at < len(here)
        ok[ok] = here[at[ok]] == t[ok]
        at, times = at[ok], times[ok]
        if not len(at):
            continue
        order = np.argsort(-(times * most[at]), kind="stable")
        at, times = at[order], times[order]
        focus = table[at[:FOCUS]]
        part = times[:FOCUS] @ focus
        # what the other coordinates can add: the bucket's maxima, or the lengths that remain
        rest = float(times[FOCUS:] @ most[at[FOCUS:]])
        left = np.sqrt(np.maximum(length ** 2 - (focus.astype(np.float64) ** 2).sum(axis=0), 0) + 1e-6 * length ** 2)
        bound = part + np.minimum(rest, float(np.sqrt((times[FOCUS:].astype(np.float64) ** 2).sum())) * left)
        go = np.flatnonzero((bound * (1 + 1e-9) + 1 >= best[i].floor) & (bound > 0))
        if len(go):
            rescored += len(go)
            score = part[go] + times[FOCUS:] @ table[at[FOCUS:]][:, go]
            keep = (score >= best[i].floor) & (score > 0)
            if keep.any():
                best[i].add(score[keep], doc[go][keep], null[go][keep])
    return rescored


def _search(items: Items, floors: list[int], k: int, batches) -> list[_Best]:
    best = [_Best(k, f) for f in floors]
    strength = np.array([math.sqrt(float((n.astype(np.float64) ** 2).sum())) * (1 + 1e-9) for _, n in items.vectors])
    rows = max(16, min(BUCKET, BUCKET_ENTRIES // max(1, len(items.terms))))
    for b in batches:
        for a in range(0, b.num_rows, rows):
            part = b.slice(a, rows)
            ids, length = part.column(0), part.column(1).to_numpy()
            offsets = part.column(2).offsets.to_numpy()
            lists = [part.column(c).values.to_numpy()[part.column(c).offsets[0].as_py():part.column(c).offsets[-1].as_py()]
                     for c in (2, 3)]
            search_bucket(items, strength, best, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
                          pc.is_null(ids).to_numpy(zero_copy_only=False), length, offsets - offsets[0], *lists)
    return best


def _search_task(items: Items, floors: list[int], k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(_search(items, floors, k, batches)):
            yield pa.record_batch([pa.array(np.full(len(b.doc), i, np.int32)), pa.array(b.doc, mask=b.null),
                                   pa.array(b.score)], ["item", "doc_id", "score"])
    return task


def _ranked_block(docs: DataFrame, rows: list[Row], k: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    items = Items(rows)
    counts = stored(docs.mapInArrow(_count_task(items.terms), "doc_id long, n long, terms array<int>, tf array<long>"), "term-counts")
    whole = counts.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    df = {r["t"]: r["n"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * whole["N"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.terms))],
                       np.int64)
    impacts = counts.where(F.size("terms") > 0).mapInArrow(
        _impact_task(weights, whole["N"], whole["L"] or 1), "doc_id long, length double, terms array<int>, impact array<long>")
    # equal vectors (copies) are dealt over several ranges by the random part of the key
    parts = max(1, -(-whole["N"] // 100_000), spark.sparkContext.defaultParallelism)
    ordered = stored(impacts.withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id()))
                     .repartitionByRange(parts, F.col("length").desc(), "deal")
                     .sortWithinPartitions(F.col("length").desc(), "deal").drop("deal"), "impact-vectors")
    longest = ordered.orderBy(F.col("length").desc()).limit(FIRST).toArrow().combine_chunks().to_batches()
    floors = [b.floor for b in _search(items, [1] * len(rows), k, longest)]
    found = ordered.mapInArrow(_search_task(items, floors, k), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = stored(found.withColumn("rank", rank).where(F.col("rank") <= k), "ranked-items")
    drop_stored(counts)
    drop_stored(ordered)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"item int, item_id {item_type}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: each item's k best documents.

    Only scores above 0 are returned, equal ones by ascending doc_id (null last).  A null text has no terms; a
    document without terms counts nowhere.  A repeated row of ``docs`` is a document each time; an item id that
    occurs more than once (null is one id) asks with its smallest non-null text.  Items without a term that any document
    holds, and empty tables, give no rows.  Other columns of both tables do not enter.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = stored(_in_blocks(items), "items")
    item_type = dict(items.dtypes)["item_id"]
    out = None
    for block in asked.select("block").distinct().orderBy("block").collect():
        rows = asked.where(F.col("block") == block["block"]).select("item_id", "text").orderBy("item_id", "text").collect()
        part = _ranked_block(texts, rows, k, item_type)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
