"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to many pivots are computed once.  For a query q and a candidate x every pivot gives
|d(q, p) - d(x, p)| <= d(q, x).  All pivots together give the greatest lower bound that these distances allow: the
pivots are placed as a simplex, q and x by their distances to it, with the height that remains above it, and the distance
of the two placed points is at most d(q, x) and at least every single pivot's bound.  With the exact norms it gives an
upper bound of the inner product, (|q|^2 + |x|^2 - d(q, x)^2) / 2.  Candidates are evaluated in the order of their
bounds until the next bound is below the k-th score found; a bound equal to it is still evaluated, so ties are
exact.

Candidates lie in shards of vectors near the same pivot (large cells are split), and a shard is only sent the
queries whose best bound there, from the shard's distance intervals, can still reach the score that a bounded
sample has already given them.  Bounds of a block of queries with a shard are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import stored, workers_find_package

#: At most; a sample of vectors that spans fewer directions gives fewer.
PIVOTS = 56
#: Vectors, by hash, that pivots are chosen from and that give every query its first scores.
SAMPLE = 2048
SHARD_ROWS = 8192
#: Shards whose intervals are sent to all tasks at once (16 bytes a pivot); more shards are routed in waves.
ROUTED_SHARDS = 20_000
#: Queries that meet a shard in one task.
QUERY_BLOCK = 32_768
#: Queries whose bounds are computed at once, and candidates that a query evaluates first (then twice as many, and so on).
_QUERIES = 128
_EVALUATE = 64


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as one array; shorter vectors are filled up with zeros."""
    rows = [np.asarray(r) for r in column.to_numpy(zero_copy_only=False)]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for o, r in zip(out, rows, strict=True):
        o[:len(r)] = r
    return out


def _match(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    a, b = _match(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2 ** 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2 ** 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)  # beyond 64 bits: saturated
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = _match(v, pivots)
    v, p = v.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1) - 2 * (v @ p.T), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots of a sample, each the farthest from what the pivots before it span."""
    if not len(sample):
        return sample
    left = sample.astype(np.float64) - sample[0]
    chosen, least = [0], 1e-3 * np.sqrt((left ** 2).sum(axis=1).max())
    while len(chosen) < min(n, len(sample)):
        far = np.sqrt((left ** 2).sum(axis=1))
        if far.max() <= least:
            break
        chosen.append(int(far.argmax()))
        axis = left[chosen[-1]] / far.max()
        left -= np.outer(left @ axis, axis)
    return sample[chosen]


class Simplex:
    """Places points by their distances to the pivots: coordinates along the simplex, and the height above it."""

    def __init__(self, pivots: np.ndarray):
        edges = pivots[1:].astype(np.float64) - pivots[0] if len(pivots) else np.zeros((0, 0))
        self.sq = (edges ** 2).sum(axis=1)
        self.turn = np.linalg.inv(np.linalg.cholesky(edges @ edges.T)).T if len(edges) else np.zeros((0, 0))

    def place(self, far: np.ndarray) -> np.ndarray:
        if not far.shape[1]:
            return np.zeros((len(far), 1))
        square = far ** 2
        along = ((square[:, :1] + self.sq - square[:, 1:]) / 2) @ self.turn
        height = np.sqrt(np.maximum(square[:, 0] - (along ** 2).sum(axis=1), 0))
        return np.concatenate([along, height[:, None]], axis=1)


def _upper(q_sq: np.ndarray, q_at: np.ndarray, x_sq: np.ndarray, x_at: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries (rows) with candidates (columns), from their places."""
    q_rest, x_rest = q_sq - (q_at ** 2).sum(axis=1), x_sq - (x_at ** 2).sum(axis=1)
    slack = 1e-6 * (q_sq.max(initial=0) + x_sq.max(initial=0)) + 1e-2  # for rounding
    return q_at @ x_at.T + (q_rest[:, None] + x_rest[None, :]) / 2 + slack


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search_shard(q: dict, x: dict, k: int, simplex: Simplex) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores): the k best of a shard that can be among a query's k best overall."""
    q_v, x_v = _match(q["v"], x["v"])
    most = float(np.abs(q_v).max(initial=0)) * float(np.abs(x_v).max(initial=0)) * max(1, x_v.shape[1])
    if most < 2 ** 53:  # products are exact in doubles
        q_v, x_v = q_v.astype(np.float64), x_v.astype(np.float64)
    q_at, x_at = simplex.place(q["far"]), simplex.place(x["far"])
    for a in range(0, len(q["id"]), _QUERIES):
        part = slice(a, a + _QUERIES)
        bounds = _upper(q["sq"][part], q_at[part], x["sq"], x_at)
        bounds[q["id"][part, None] == x["id"][None, :]] = -np.inf
        for i, bound in enumerate(bounds):
            floor = q["floor"][a + i]
            scores, ids, least, step = np.zeros(0, np.int64), np.zeros(0, np.int64), floor, _EVALUATE
            open_ = np.flatnonzero((bound >= floor) & (bound > -np.inf))
            while len(open_):
                if len(open_) > step:  # the step highest bounds; the others wait
                    first = np.argpartition(-bound[open_], step - 1)
                    now, open_ = open_[first[:step]], open_[first[step:]]
                else:
                    now, open_ = open_, open_[:0]
                if x_v.dtype == np.float64:
                    got = np.rint(x_v[now] @ q_v[a + i]).astype(np.int64)
                else:
                    got = _dot(q_v[a + i:a + i + 1], x_v[now])[0]
                scores, ids = np.r_[scores, got], np.r_[ids, x["id"][now]]
                top = _best(scores, ids, k)
                scores, ids = scores[top], ids[top]
                if len(scores) == k:
                    least = max(least, float(scores[-1]))
                open_ = open_[bound[open_] >= least]  # none left: no other candidate can reach the k-th score
                step *= 2
            keep = scores >= floor
            yield a + i, ids[keep], scores[keep]


def _columns(table: pa.Table) -> dict:
    return {"id": table["vec_id"].to_numpy(), "v": _vectors(table["v"]), "sq": table["sq"].to_numpy(),
            "far": np.array(table["far"].to_pylist(), np.float64).reshape(len(table), -1)}


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = PIVOTS,
                       sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Components become floor(scale * x); queries are the rows whose vec_id is divisible by ``every``, candidates
    all rows with another vec_id; ties go to the smaller vec_id.  Rows with a null id, a null vector or a null or
    non-finite component take no part; shorter vectors count as filled up with zeros; scores beyond 64 bits are
    saturated.  A repeated candidate row is a candidate each time; repeated rows of a query ask once, with the
    first of the different vectors in order.  Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    workers_find_package(spark)
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(finite, F.lit(False)))
            .select("vec_id", ints.alias("v")))
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    s_ids, s_v = first["vec_id"].to_numpy(), _vectors(first["v"])
    pivot = choose_pivots(s_v, pivots)
    simplex = Simplex(pivot)

    def table_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(b.column(1))
            far = _distances(v, pivot)
            sq = (v.astype(np.float64) ** 2).sum(axis=1)
            floor = np.full(len(v), -np.inf)
            asks = np.flatnonzero(b.column(0).to_numpy() % every == 0)
            for a in range(0, len(asks), 256):
                part = asks[a:a + 256]
                got = _dot(v[part], s_v).astype(np.float64)
                got[b.column(0).to_numpy()[part, None] == s_ids[None, :]] = -np.inf
                if got.shape[1] >= k:
                    floor[part] = np.partition(got, -k, axis=1)[:, -k]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sq), pa.array(list(far), pa.list_(pa.float64())),
                                   pa.array(far.argmin(axis=1) if far.shape[1] else np.zeros(len(v), np.int64)),
                                   pa.array(floor)], ["vec_id", "v", "sq", "far", "cell", "floor"])

    table = stored(rows.mapInArrow(table_task, "vec_id long, v array<long>, sq double, far array<double>, cell long, "
                                               "floor double").withColumn("row", F.monotonically_increasing_id()),
                   "pivot-table")
    cells = table.groupBy("cell").agg(F.count("*").alias("n")).collect()  # one row per pivot at most
    splits = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // shard_rows))]) if cells else None
    if splits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = sum(-(-c["n"] // shard_rows) for c in cells)
    candidates = table.withColumn("shard", F.concat_ws("-", "cell", F.pmod(F.xxhash64("row"), splits[F.col("cell")])))
    queries = (table.where(F.col("vec_id") % every == 0)
               .groupBy("vec_id").agg(F.min(F.struct("v", "sq", "far", "floor")).alias("q")).select("vec_id", "q.*"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = (_routed(candidates, queries, -(-shards // ROUTED_SHARDS))
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    if blocks == 1:
        blocked = candidates.withColumn("block", F.lit(0).cast("long"))
    else:  # a shard's candidates go to the blocks that ask for it
        blocked = candidates.join(stored(asked.select("shard", "block").distinct(), "asked-shards"), "shard")
    blocked = blocked.select("shard", "block", "vec_id", "v", "sq", "far")

    def shard_task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(left) and len(right):
            q = _columns(left) | {"floor": left["floor"].to_numpy()}
            for i, ids, scores in search_shard(q, _columns(right), k, simplex):
                for o, c in zip(out, (np.full(len(ids), q["id"][i]), ids, scores), strict=True):
                    o.append(c)
        return pa.table({n: np.concatenate([*o, np.zeros(0, np.int64)])
                         for n, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = (asked.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block"))
             .applyInArrow(shard_task, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _routed(candidates: DataFrame, queries: DataFrame, waves: int) -> DataFrame:
    """The queries, once for every shard that can hold one of their k best."""
    spans = stored(candidates.select("shard", "sq", F.posexplode_outer("far").alias("p", "d"))
                   .groupBy("shard", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("sq").alias("sq"))
                   .groupBy("shard").agg(F.max("sq").alias("sq"),
                                         F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("span")),
                   "pivot-spans")
    asked = queries.select("vec_id", "v", "sq", "far", "floor")
    schema = "shard string, vec_id long, v array<long>, sq double, far array<double>, floor double"
    out = None
    for wave in range(waves):
        part = spans.where(F.pmod(F.xxhash64("shard"), F.lit(waves)) == wave).toArrow()
        routed = asked.mapInArrow(_router(part), schema)
        out = routed if out is None else out.unionByName(routed)
    return out


def _router(spans: pa.Table):
    names = spans["shard"].to_pylist()
    sq = spans["sq"].to_numpy()
    lo, hi = (np.array([[p[end] for p in s if p["p"] is not None] for s in spans["span"].to_pylist()], np.float64)
              for end in ("lo", "hi"))

    def route_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.array(batch.column(3).to_pylist(), np.float64).reshape(len(batch), -1)
            q_sq, floor = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for j, name in enumerate(names):
                low = np.maximum(np.maximum(lo[j] - far, far - hi[j]).max(axis=1, initial=0), 0)
                total = q_sq + sq[j]
                go = np.flatnonzero((total - low * low) / 2 + 1e-6 * total + 1e-2 >= floor)
                if len(go):
                    rows = batch.take(pa.array(go))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(go), pa.string()), *rows.columns],
                                                     ["shard", *batch.schema.names])

    return route_task
