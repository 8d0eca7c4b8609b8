"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most r bits agree in one of r + 1 bands of bits, so only fingerprints that share
a band value are compared.  Within a bucket the 64 bit planes lie vertically (one bit per fingerprint); a
comparison XORs planes and feeds carry-save counters that update many distances at once, and stops as soon as
every distance in the block is beyond the radius.  Equal fingerprints are one node, buckets beyond a block are
compared block against block, and each task passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import own_columns_apart, stored, workers_find_package
from churnlens.llm.graph import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
#: Fingerprints of a block; larger buckets are compared block against block.
BLOCK = 2048
#: Buckets up to this size are compared together, shifted against themselves.
SMALL = 48
#: Bucket members of a task.
TASK_ROWS = 40_000
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Signed 64-bit SimHash of a whole text; 0 without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        part = w[a:a + _CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words \
            else [b" ".join(w)]
        bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8))
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, n) array of 0/1: the bit planes of n unsigned 64-bit fingerprints."""
    return np.ascontiguousarray(np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T)


class _Counters:
    """Carry-save counters of differing bits; sticks once beyond the radius (at most 3)."""

    def __init__(self, shape: tuple, radius: int):
        self.one, self.two = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
        self.over, self.radius = np.zeros(shape, np.uint8), radius

    def add(self, differ: np.ndarray) -> None:
        carry = self.one & differ
        self.one ^= differ
        self.over |= self.two & carry
        self.two ^= carry

    def beyond(self) -> np.ndarray:
        """Bits of the distances that exceed the radius."""
        if self.radius >= 3:
            return self.over
        if self.radius == 2:
            return self.over | (self.two & self.one)
        return self.over | self.two | (self.one if self.radius == 0 else 0)


def shifted_links(sides: np.ndarray, same: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Rows i (of n - shift) whose fingerprint is within the radius of row i + shift's, where ``same`` holds."""
    n = sides.shape[1] - shift
    mask = np.packbits(same)
    counters = _Counters(mask.shape, radius)
    left, right = np.packbits(sides[:, :n], axis=1), np.packbits(sides[:, shift:], axis=1)
    for k in range(64):
        counters.add(left[k] ^ right[k])
        if k % 8 == 7 and not (mask & ~counters.beyond()).any():
            return np.zeros(0, np.int64)  # the block is abandoned
    return np.flatnonzero(np.unpackbits(mask & ~counters.beyond(), count=n))


def block_links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of left, rows of right within the radius), by planes of the right block."""
    n = len(right)
    planes_right = np.packbits(planes(right), axis=1)
    turn = np.where(planes(left), np.uint8(255), np.uint8(0))
    valid = np.packbits(np.ones(n, np.uint8))
    for a in range(0, len(left), 256):
        b = min(a + 256, len(left))
        counters = _Counters((b - a, len(valid)), radius)
        for k in range(64):
            counters.add(planes_right[k][None, :] ^ turn[k, a:b, None])
            if k % 8 == 7 and not (valid & ~counters.beyond()).any():
                break
        near = valid & ~counters.beyond()
        for i in np.flatnonzero(near.any(axis=1)):
            yield a + int(i), np.flatnonzero(np.unpackbits(near[i], count=n))


class _Forest:
    """Union-find over rows, with whole arrays of links at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[rows]
            if (up == rows).all():
                return rows
            rows = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _task_links(prints: np.ndarray, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, mine: np.ndarray,
                radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (fingerprints, roots) of the links within the buckets of a task.

    Rows of a job of two blocks (lo < hi) are compared across ``mine`` only; all other rows within their bucket.
    """
    _, job = np.unique(np.stack([bucket, lo, hi], axis=1), axis=0, return_inverse=True)
    size = np.bincount(job)[job]
    order = np.lexsort((mine, job, -size))
    prints, job, size = prints[order], job[order], size[order]
    lo, hi, mine = lo[order], hi[order], mine[order]
    forest = _Forest(len(prints))
    small = int(np.searchsorted(-size, -SMALL))  # rows before it are in larger jobs
    small = max(small, int(np.flatnonzero(lo < hi).max()) + 1 if (lo < hi).any() else 0)
    starts = np.flatnonzero(np.r_[True, job[1:small] != job[:max(small - 1, 0)]]) if small else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts, small)[1:], strict=True):
        cut = a + int(np.searchsorted(mine[a:b], hi[a])) if lo[a] < hi[a] else a
        left, right = (slice(a, cut), slice(cut, b)) if lo[a] < hi[a] else (slice(a, b), slice(a, b))
        for i, near in block_links(prints[left], prints[right], radius):
            near = near + right.start
            forest.link(np.full(len(near), left.start + i), near)
    if small < len(prints):
        sides, job, size = planes(prints[small:]), job[small:], size[small:]
        for shift in range(1, int(size.max())):
            m = int(np.searchsorted(-size, -shift))  # rows in jobs of more than ``shift``
            if m <= shift:
                break
            a = shifted_links(sides[:, :m], job[:m - shift] == job[shift:m], shift, radius) + small
            forest.link(a, a + shift)
    root = forest.find(np.arange(len(prints)))
    out = np.flatnonzero(root != np.arange(len(prints)))
    return prints[out], prints[root[out]]


def linked_prints(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct fingerprints (fp long) -> (src, dst): a spanning forest of the links of every bucket."""
    widths = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    bands, at = [], 0
    for i, w in enumerate(widths):
        bands.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", 64 - at - w).bitwiseAND((1 << w) - 1)
                              .alias("value")))
        at += w
    members = nodes.select("fp", F.explode(F.array(*bands)).alias("b")).select("fp", "b.band", "b.value")
    sizes = stored(members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    rows = sizes.where(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0
    slots = max(1, -(-rows // task_rows))
    m = members.join(sizes, ["band", "value"]).withColumn("bucket", F.xxhash64("band", "value"))
    m = m.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    m = m.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    m = m.withColumn("job", F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(slots)))
                     .otherwise(F.xxhash64("bucket", "lo", "hi")))

    def link_task(table: pa.Table) -> pa.Table:
        prints = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        src, dst = _task_links(prints, *[table[c].to_numpy().astype(np.int64)
                                         for c in ("bucket", "lo", "hi", "mine")], radius)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return (m.select("job", "fp", "bucket", "lo", "hi", "mine").groupBy("job")
            .applyInArrow(link_task, "src long, dst long"))


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) -> doc_id, text_hash, fp (long), fingerprint (hex), component_id, group.

    Words are runs of non-white-space with A-Z lower-cased; a text of fewer words than a shingle is one shingle; a
    null, empty or blank text has fingerprint 0, linked like any other.  component_id is the smallest doc_id of
    the documents reachable by links of ``radius`` bits at most (null if none has an id), ``group`` the smallest
    fingerprint there.  One row per row, repeated rows included; an empty table gives no rows; other columns are
    ignored.  ``radius`` is 3 at most (two counter planes).
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    spark = docs.sparkSession
    workers_find_package(spark)

    def print_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps, pa.int64())],
                                  ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                                F.xxhash64(text).alias("text_hash"))
                    .mapInArrow(print_task, "doc_id long, text_hash long, fp long"), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = connected_components(stored(linked_prints(classes.select("fp"), radius), "simhash-links"))
    rooted = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("group")), "simhash-rooted")
    ids = stored(rooted.groupBy("group").agg(F.min("least").alias("component_id")), "simhash-ids")
    labels = stored(rooted.join(ids, "group").select("fp", "group", "component_id"), "simhash-labels")
    return prints.join(labels, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                            .alias("fingerprint"), "component_id", "group")


def without_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents of which one of each group stays: the one with the smallest doc_id, then text hash.

    Of rows with one doc_id and text the one whose other columns have the least hash stays.  The columns of
    ``docs`` come back unchanged.  What goes is decided on (doc_id, text hash); the documents only meet the keys that
    go, which Spark broadcasts up to its threshold, and only repeated rows are aggregated with their texts.
    """
    groups = simhash_groups(docs, words, radius).select("group", "doc_id", "text_hash")
    keys = stored(groups.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n")), "simhash-keys")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = stored(keys.groupBy("group").agg(F.min(order).alias("first")), "simhash-first")
    judged = (keys.join(first, "group").withColumn("stays", order == F.col("first")).where("NOT stays OR n > 1")
              .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"))
    judged = stored(judged, "simhash-judged")
    same = (F.col("_id").eqNullSafe(F.col("doc_id").cast("long"))
            & F.col("_hash").eqNullSafe(F.xxhash64(F.col("text").cast("string"))))
    kinds = dict(docs.dtypes)

    def work(own: DataFrame) -> DataFrame:
        alone = own.join(judged.select("_id", "_hash"), same, "left_anti")
        repeated = judged.where("stays").select("_id", "_hash")
        if not repeated.limit(1).count():
            return alone
        other = F.xxhash64(F.lit(HASH_SEED), *[o for o, c in zip(own.columns, docs.columns, strict=True)
                                               if c not in ("doc_id", "text") and "map<" not in kinds[c]])
        one = (own.join(repeated, same).groupBy("_id", "_hash")
               .agg(F.min_by(F.struct(*own.columns), other).alias("row")).select("row.*"))
        return alone.unionByName(one)

    return own_columns_apart(docs, ["doc_id", "text"], work)
