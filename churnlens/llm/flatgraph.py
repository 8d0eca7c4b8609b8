"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards (their nearest centroid and those nearly as near).  Each shard
builds a robust-pruned neighbour graph; the adjacency lists of a vector's shards are united.  Every vector then
searches the united graph in each of its shards: greedily from the shard's medoid, then expanding every vertex
found within the range until no new one appears.  Links found are verified in double precision.  The number of
cells grows with the vectors: beyond a level of centroids, further levels are fitted on what the last one leaves.

Sampled vertices are compared with all vectors to audit the recall, drawn until enough of them have links.  Where
links are too rare for that, planted partners judge it: before the search, vectors turned away from sampled ones by
a known angle within the range join the table (they never count as links), and the search must find their origins.
Too low a recall repeats the work with more overlap and a wider beam.  If it stays too low, every pair that can be
in range is compared: each vector meets all of every cell that may hold a partner's home.

Equal vectors are one vertex.  A pair is counted in the first shard that holds both, so no pair is emitted: each
shard passes on link counts and a spanning forest.  A shard too large for a task is split into blocks, and every
two blocks of it meet in one task.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import stored, workers_find_package
from churnlens.llm.graph import connected_components
from churnlens.llm.simhash import _Forest

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Mean vectors of a cluster before overlap, centroids of a level, and vectors they are fitted on (by hash).
CLUSTER_ROWS, LEVEL_CENTROIDS, FIT_ROWS = 700, 1024, 8192
#: Most shards of a vector, and how much lower than the best its nearness to their centroids may be (on the first
#: level the cosine).
OVERLAP, MARGIN = 3, 0.12
#: Vertices of a block; larger shards are split.
BLOCK = 3000
#: Neighbours a vertex keeps, nearest and random candidates, robust-prune factor, beam of the greedy search.
DEGREE, NEAREST, RANDOM, ALPHA, BEAM = 16, 40, 16, 1.2, 16
#: Range expansion also goes through vertices this much below the threshold.
SLACK = 0.03
#: Vectors the audit begins with, the recall it asks for, and how often the work is repeated with wider settings.
AUDIT_ROWS, AUDIT_RECALL, ATTEMPTS = 64, 0.98, 3
#: Vertices with true links that the audit needs; rounds in which it draws eight times as many vectors each.
AUDIT_LINKED, AUDIT_ROUNDS = 256, 3
#: Vectors that get a planted partner; its cosine lies in the lower half of the range, where links are hardest to find.
PLANTED = 1024


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (double) of a list column, and which rows are vectors: not null or zero, all finite."""
    rows = column.to_pylist()
    width = max([width or 0, *(len(r) for r in rows if r is not None)])
    out = np.zeros((len(rows), width))
    good = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r and None not in r:
            v = np.asarray(r, np.float64)
            top = np.abs(v).max()
            if np.isfinite(v).all() and top > 0:
                v = v / top  # no overflow or underflow in the norm
                out[i, :len(v)] = v / np.sqrt((v * v).sum())
                good[i] = True
    return out, good


def _nearness(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(1 + |v|^2 - |v - c|^2) / 2 of every vector and centre: the cosine of two unit vectors."""
    return v @ centre.T + (1 - (centre * centre).sum(axis=1)) / 2


def fit_centroids(sample: np.ndarray, k: int, unit: bool = True, rounds: int = 8) -> np.ndarray:
    """K-means from evenly spread starts; with ``unit`` the centres are unit vectors."""
    if k <= 1 or len(sample) <= 1:
        return sample[:1]
    centre = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        own = _nearness(sample, centre).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        by = np.sqrt((total * total).sum(axis=1)) if unit else np.bincount(own, minlength=len(centre))
        centre = np.where(by[:, None] > 0, total / np.where(by > 0, by, 1)[:, None], centre)
    return centre


def fit_levels(sample: np.ndarray, cells: int) -> list[np.ndarray]:
    """Centroids of as many levels as ``cells`` take; a level is fitted on the differences from the last one's."""
    levels: list[np.ndarray] = []
    while not levels or (cells > 1 and len(levels[-1]) > 1):
        centre = fit_centroids(sample, min(LEVEL_CENTROIDS, cells), not levels)
        levels.append(centre)
        if len(centre):
            sample = sample - centre[_nearness(sample, centre).argmax(axis=1)]
        cells = -(-cells // max(1, len(centre)))
    return levels


def nearest_cells(v: np.ndarray, levels: list[np.ndarray], overlap: int, margin: float) -> list[np.ndarray]:
    """The cells of every vector: those whose sums of centroids are nearest, at most ``overlap``, within ``margin``."""
    path = np.zeros((len(v), 1), np.int64)
    sums = np.zeros((len(v), 1, v.shape[1]))
    score = np.ones((len(v), 1))
    for centre in levels:
        # nearness to path + centre, by the parts of its square that change
        each = np.stack([v @ centre.T - sums[:, i] @ centre.T - (centre * centre).sum(axis=1) / 2
                         for i in range(sums.shape[1])], axis=1)
        base = np.einsum("ij,ikj->ik", v, sums) + (1 - (sums * sums).sum(axis=2)) / 2
        each = np.where(np.isfinite(score)[:, :, None], each + base[:, :, None], -np.inf).reshape(len(v), -1)
        top = np.argsort(-each, axis=1, kind="stable")[:, :overlap]
        score = np.take_along_axis(each, top, axis=1)
        score = np.where(score >= score[:, :1] - margin, score, -np.inf)
        last, own = top // len(centre), top % len(centre)
        path = np.take_along_axis(path, last, axis=1) * len(centre) + own
        sums = np.take_along_axis(sums, last[:, :, None], axis=1) + centre[own]
    return [np.sort(p[np.isfinite(k)]) for p, k in zip(path, score, strict=True)]


def planted_partners(nodes: DataFrame, threshold: float, n: int = PLANTED) -> DataFrame:
    """(row, unit, n) of a partner in range for each of ``n`` vertices drawn by hash.

    Row -1 - r is the partner of vertex r, turned from it in a random direction; its weight n is 0.
    """
    def turn_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), -1)
            out = np.empty_like(v)
            for i, (row, u) in enumerate(zip(rows, v, strict=True)):
                rng = np.random.default_rng(int(row))
                aside = rng.normal(size=len(u))
                aside -= (aside @ u) * u
                norm = np.sqrt(aside @ aside)
                cosine = threshold + (1 - threshold) * rng.uniform(1e-6, 0.5)
                out[i] = cosine * u + np.sqrt(max(0.0, 1 - cosine ** 2)) * aside / norm if norm > 1e-9 else u
            yield pa.record_batch([pa.array(-1 - rows), pa.array(list(out), pa.list_(pa.float64())),
                                   pa.array(np.zeros(len(b), np.int64))], ["row", "unit", "n"])

    return (nodes.select("row", "unit").orderBy(F.xxhash64("row", F.lit(PLANTED)), "row").limit(n)
            .mapInArrow(turn_task, "row long, unit array<double>, n long"))


def robust_graph(v: np.ndarray, degree: int = DEGREE, seed: int = 1) -> list[np.ndarray]:
    """Neighbour lists of unit vectors: robust-pruned from the nearest and some random vertices, both ways."""
    n = len(v)
    rng = np.random.default_rng(seed)
    src, dst = [], []
    near = min(NEAREST + 1, n)
    for a in range(0, n, 256):
        b = min(a + 256, n)
        sims = v[a:b] @ v.T
        own = np.arange(a, b)
        sims[own - a, own] = -2
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([cand, rng.integers(0, n, (b - a, RANDOM))], axis=1)
        far = 2 - 2 * np.take_along_axis(sims, cand, axis=1)  # squared distances; the vertex itself is at 6
        alive = cand != own[:, None]
        among = 2 - 2 * np.einsum("bcd,bed->bce", v[cand], v[cand], optimize=True)
        for _ in range(degree):
            pick = np.where(alive, far, np.inf).argmin(axis=1)
            row = np.arange(b - a)
            ok = alive[row, pick]
            if not ok.any():
                break
            src.append(own[ok])
            dst.append(cand[row, pick][ok])
            alive &= ~(ALPHA ** 2 * among[row, pick] <= far)
            alive[row, pick] = False
    src, dst = np.concatenate(src), np.concatenate(dst)
    src, dst = np.r_[src, dst], np.r_[dst, src]
    code = np.unique(src * n + dst)
    src, dst = code // n, code % n
    # a hub keeps its nearest 2 * degree
    far = -np.einsum("ij,ij->i", v[src], v[dst])
    order = np.lexsort((far, src))
    src, dst = src[order], dst[order]
    starts = np.searchsorted(src, np.arange(n + 1))
    return [dst[starts[i]:min(starts[i] + 2 * degree, starts[i + 1])] for i in range(n)]


def range_search(v: np.ndarray, adjacency: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vertex) with cosine >= threshold that the graph search finds, every vertex being a query.

    ``adjacency`` has a row per vertex, filled up with -1.  Greedy search keeps the ``beam`` best vertices seen,
    starting from the medoid; then every vertex in range is expanded.
    """
    n = len(v)
    small = v.astype(np.float32)
    medoid = int((v @ v.sum(axis=0)).argmax())
    out_q, out_x = [], []
    for a in range(0, n, 512):
        b = min(a + 512, n)
        m = b - a
        q = small[a:b]
        seen = np.zeros((m, n), bool)
        seen[:, medoid] = True
        ids = np.full((m, beam), -1)
        sims = np.full((m, beam), -2, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, q @ small[medoid], False
        hit_q, hit_x = [np.arange(m)], [np.arange(a, b)]  # a query's own vertex is a start of the expansion
        first = np.flatnonzero(sims[:, 0] >= threshold - SLACK)
        hit_q.append(first)
        hit_x.append(np.full(len(first), medoid))
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                break
            pick = np.where(done[live], -3, sims[live]).argmax(axis=1)
            done[live, pick] = True
            near = adjacency[ids[live, pick]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            who, x = live[r], near[r, c]
            seen[who, x] = True
            s = np.einsum("ij,ij->i", q[who], small[x])
            close = s >= threshold - SLACK
            hit_q.append(who[close])
            hit_x.append(x[close])
            more = np.full(near.shape, -2, np.float32)
            more[r, c] = s
            all_s = np.concatenate([sims[live], more], axis=1)
            all_i = np.concatenate([ids[live], near], axis=1)
            all_d = np.concatenate([done[live], ~fresh], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            done[live] = np.take_along_axis(all_d, top, 1)
        hq, hx = np.concatenate(hit_q), np.concatenate(hit_x)
        seen[hq, hx] = True
        code = np.unique(hq * n + hx)
        found = [code]
        while len(code):  # expand the range
            fresh_codes = []
            for at in range(0, len(code), 16_384):
                who, x = code[at:at + 16_384] // n, code[at:at + 16_384] % n
                near = adjacency[x]
                r, c = np.nonzero(near >= 0)
                w, y = who[r], near[r, c]
                new = ~seen[w, y]
                pair = np.unique(w[new] * n + y[new])
                w, y = pair // n, pair % n
                seen[w, y] = True
                fresh_codes.append(pair[np.einsum("ij,ij->i", q[w], small[y]) >= threshold - SLACK])
            code = np.concatenate(fresh_codes)
            found.append(code)
        code = np.concatenate(found)
        who, x = code // n, code % n
        exact = np.einsum("ij,ij->i", v[a + who], v[x]) >= threshold  # verified in double precision
        out_q.append(a + who[exact])
        out_x.append(x[exact])
    return np.concatenate(out_q), np.concatenate(out_x)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell in both rows of two arrays of cells (filled up with -1)."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return np.where(same.any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)


def _cells(table: pa.Table) -> np.ndarray:
    lists = table["cells"].to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=1)), -1, np.int64)
    for o, x in zip(out, lists, strict=True):
        o[:len(x)] = x
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table["unit"].to_pylist(), np.float64).reshape(len(table), -1)


def _build_task(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    rows, v = table["row"].to_numpy(), _matrix(table)
    lists = robust_graph(v) if len(v) > 1 else [np.zeros(0, np.int64)] * len(v)
    return pa.table({"row": pa.array(rows, pa.int64()),
                     "near": pa.array([rows[x] for x in lists], pa.list_(pa.int64()))})


def _search_task(threshold: float, beam: int):
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, v, cells = table["row"].to_numpy(), _matrix(table), _cells(table)
        block, weight = table["mine"].to_numpy(), table["n"].to_numpy()
        cell, lo, hi = (table[c][0].as_py() for c in ("cell", "lo", "hi"))
        local = []
        for near in table["near"].to_pylist():
            at = np.searchsorted(rows, near := np.asarray(near, np.int64)) if near else np.zeros(0, np.int64)
            at = at[at < len(rows)] if not len(near) else at[(at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)]
                                                                                == near)]
            local.append(at)
        adjacency = np.full((len(rows), max(1, *map(len, local), 1)), -1)
        for o, x in zip(adjacency, local, strict=True):
            o[:len(x)] = x
        q, x = range_search(v, adjacency, threshold, beam)
        pair = np.unique(np.where(q < x, q * len(rows) + x, x * len(rows) + q)[q != x])
        a, b = pair // len(rows), pair % len(rows)
        mine = _first_common(cells[a], cells[b]) == cell
        if lo < hi:
            mine &= block[a] != block[b]
        a, b = a[mine], b[mine]
        origin = a[rows[a] == -1 - rows[b]]  # planted partners (negative rows) that found their origin
        real = rows[a] >= 0
        a, b = a[real], b[real]
        links = (np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))).astype(np.int64)
        others = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        forest = _Forest(len(rows))
        forest.link(a, b)
        found = _found(rows, forest, links, others)
        none = np.zeros(len(origin), np.int64)
        return pa.concat_tables([found, pa.table({"row": rows[origin], "root": rows[origin], "links": none,
                                                  "others": none})])
    return search


def _found(rows: np.ndarray, forest: _Forest, links: np.ndarray, others: np.ndarray) -> pa.Table:
    root = forest.find(np.arange(len(rows)))
    some = np.flatnonzero(others)
    return pa.table({"row": rows[some], "root": rows[root[some]], "links": links[some].astype(np.int64),
                     "others": others[some].astype(np.int64)})


def _compare_task(threshold: float):
    """Compare all pairs of a job; a pair counts in the home cell of its lower row."""
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, v, home = table["row"].to_numpy(), _matrix(table), table["home"].to_numpy()
        block, weight = table["mine"].to_numpy(), table["n"].to_numpy()
        cell, lo, hi = (table[c][0].as_py() for c in ("cell", "lo", "hi"))
        forest, n = _Forest(len(rows)), len(rows)
        links, others = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at_home = np.flatnonzero(home == cell)
        for k in range(0, len(at_home), 256):
            own = at_home[k:k + 256]
            near = (v[own] @ v.T >= threshold) & (own[:, None] < np.arange(n)[None, :])
            if lo < hi:
                near &= block[own][:, None] != block[None, :]
            i, b = np.nonzero(near)
            a = own[i]
            links += (np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)).astype(np.int64)
            others += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            forest.link(a, b)
        return _found(rows, forest, links, others)
    return compare


def _shards(nodes: DataFrame, levels: list[np.ndarray], overlap: int, margin: float) -> DataFrame:
    """Vertices with their cells, once for every job (cell, lo, hi: two blocks of a cell) they belong to."""
    def cell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), -1)
            cells = [c for i in range(0, len(v), 512) for c in nearest_cells(v[i:i + 512], levels, overlap, margin)]
            yield pa.record_batch([*b.columns, pa.array(cells, pa.list_(pa.int64()))], ["row", "unit", "n", "cells"])

    dealt = stored(nodes.select("row", "unit", "n").mapInArrow(
        cell_task, "row long, unit array<double>, n long, cells array<long>"), "graph-cells")
    return _jobs(dealt, _cell_rows(dealt), "cells")


def _cell_rows(dealt: DataFrame) -> DataFrame:
    """(cell, rows) of every cell that holds some."""
    return stored(dealt.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows")),
                  "graph-sizes")


def _jobs(dealt: DataFrame, sizes: DataFrame, kept: str) -> DataFrame:
    blocks = sizes.select("cell", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks"))
    m = dealt.withColumn("cell", F.explode("cells")).join(blocks, "cell")
    m = m.withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return m.select("row", "unit", "n", kept, "cell", "mine", F.least("mine", "other").alias("lo"),
                    F.greatest("mine", "other").alias("hi"))


def _exact_links(nodes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """(row, root, links, others) of every vertex with links, once per job, by comparison of all possible pairs.

    If x has its home (nearest centroid) at c and y at d, then y's products with d and c differ by at most
    |y - x| |d - c|; so y is dealt to every cell c within that bound, with |y - x| at the threshold, and meets x
    there.  Where so few cells are ruled out that dealing costs more than it saves, one cell holds all.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def dealt_to(centres: np.ndarray) -> DataFrame:
        between = np.sqrt(np.stack([((centres - c) ** 2).sum(axis=1) for c in centres]))

        def home_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), -1)
                sims = v @ centres.T
                home = sims.argmax(axis=1)
                near = sims.max(axis=1)[:, None] - sims <= reach * between[home] + 1e-9
                yield pa.record_batch([*b.columns, pa.array([np.flatnonzero(k) for k in near], pa.list_(pa.int64())),
                                       pa.array(home, pa.int64())], ["row", "unit", "n", "cells", "home"])

        return stored(nodes.select("row", "unit", "n").mapInArrow(
            home_task, "row long, unit array<double>, n long, cells array<long>, home long"), "graph-homes")

    dealt = dealt_to(centres)
    sizes = _cell_rows(dealt)
    n = nodes.count()
    if sizes.agg(F.sum(F.col("rows") * F.ceil(F.col("rows") / BLOCK))).first()[0] > n * -(-n // BLOCK):
        dealt = dealt_to(centres[:1])
        sizes = _cell_rows(dealt)
    return stored(_jobs(dealt, sizes, "home").groupBy("cell", "lo", "hi").applyInArrow(
        _compare_task(threshold), "row long, root long, links long, others long"), "graph-links")


def _links(nodes: DataFrame, levels: list[np.ndarray], threshold: float, overlap: int, margin: float, beam: int
           ) -> DataFrame:
    """(row, root, links, others: links to distinct vertices) of every vertex with links, once per job.

    Planted partners among ``nodes`` are no links of others; each has a row of its own if its origin was found.
    """
    jobs = _shards(nodes, levels, overlap, margin)
    built = (jobs.select("row", "unit", "cell", "lo", "hi").groupBy("cell", "lo", "hi")
             .applyInArrow(_build_task, "row long, near array<long>"))
    united = stored(built.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")),
                    "graph-adjacency")
    return stored(jobs.join(united, "row").groupBy("cell", "lo", "hi")
                  .applyInArrow(_search_task(threshold, beam), "row long, root long, links long, others long"),
                  "graph-links")


def audited_recall(nodes: DataFrame, counts: DataFrame, threshold: float, planted: tuple[int, int] | None = None
                   ) -> float | None:
    """Mean share of the links of a sampled vertex, by comparison with all, that ``counts`` (row, others) has.

    Links to distinct vertices count, and every sampled vertex with links counts alike.  Vertices are drawn until
    AUDIT_LINKED of them have links or all are drawn.  If neither comes about in AUDIT_ROUNDS, the planted partners
    (how many were found, of how many) count beside the vertices with links; None without any.
    """
    ordered = nodes.orderBy(F.xxhash64("row"), "row")
    drawn, shares, size = 0, [], nodes.count()
    for k in range(AUDIT_ROUNDS):
        upto = drawn + AUDIT_ROWS * 8 ** k
        sample = ordered.limit(upto).select("row", "unit").toArrow().slice(drawn)
        s_rows, s = sample["row"].to_numpy(), _matrix(sample)

        def audit_task(batches: Iterator[pa.RecordBatch], s_rows=s_rows, s=s) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(s_rows), np.int64)
            for b in batches:
                v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), -1)
                for i in range(0, len(s), 512):
                    near = s[i:i + 512] @ v.T >= threshold
                    near &= s_rows[i:i + 512, None] != b.column(0).to_numpy()[None, :]
                    total[i:i + 512] += near.sum(axis=1)
            some = total > 0
            yield pa.record_batch([pa.array(s_rows[some]), pa.array(total[some])], ["row", "truth"])

        truth = (nodes.select("row", "unit").mapInArrow(audit_task, "row long, truth long")
                 .groupBy("row").agg(F.sum("truth").alias("truth")))
        got = truth.join(counts, "row", "left").agg(
            F.sum(F.least("truth", F.coalesce("others", F.lit(0))) / F.col("truth")), F.count("*")).first()
        shares.append((got[0] or 0.0, got[1]))
        drawn = upto
        linked = sum(n for _, n in shares)
        if linked >= AUDIT_LINKED or drawn >= size:
            return sum(x for x, _ in shares) / linked if linked else 1.0
    return (sum(x for x, _ in shares) + planted[0]) / (linked + planted[1]) if planted and planted[1] else None


def planted_found(searched: DataFrame, found: DataFrame) -> tuple[int, int]:
    """How many of the planted partners among ``searched`` found their origin, and how many there are."""
    return found.where("row < 0").select("row").distinct().count(), searched.where("row < 0").count()


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept.

    One row per row.  n_links counts the other rows linked directly (cosine >= threshold in double precision);
    equal vectors are linked.  component_id is the smallest vec_id reachable (null if none has an id), kept tells
    whether it is the row's own.  Rows whose vector is null, zero or holds null or non-finite components have no
    link and are their own component.  Shorter vectors count as filled up with zeros.  Repeated rows, also of one
    vec_id, are vectors of their own.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    workers_find_package(spark)
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0

    def unit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, good = unit_rows(b.column(1), width)
            yield pa.record_batch([b.column(0), pa.array([u if g else None for u, g in zip(unit, good, strict=True)],
                                                         pa.list_(pa.float64()))], ["vec_id", "unit"])

    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
                  .mapInArrow(unit_task, "vec_id long, unit array<double>")
                  .withColumn("row", F.monotonically_increasing_id()), "graph-rows")
    nodes = stored(rows.where("unit IS NOT NULL").groupBy("unit").agg(
        F.min("row").alias("row"), F.count("*").alias("n"), F.min("vec_id").alias("least")), "graph-nodes")
    size = nodes.count()
    if size:
        fit = nodes.orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).select("unit").toArrow()
        levels = fit_levels(_matrix(fit), -(-size // CLUSTER_ROWS))
        searched = stored(nodes.select("row", "unit", "n").unionByName(planted_partners(nodes, threshold)),
                          "graph-searched")
        overlap, margin, beam = OVERLAP, MARGIN, BEAM
        recall: float | None = 0.0
        for attempt in range(ATTEMPTS):
            found = _links(searched, levels, threshold, overlap, margin, beam)
            links = found.where("row >= 0")
            counts = links.groupBy("row").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
            recall = audited_recall(nodes, counts, threshold, planted_found(searched, found))
            log.info("recall of the audited sample: %s (attempt %d)", recall, attempt + 1)
            if recall is None or recall >= AUDIT_RECALL:
                break
            overlap, margin, beam = 2 * overlap, 2 * margin, 2 * beam
        if recall is None or recall < AUDIT_RECALL:
            log.info("all possible pairs are compared")
            links = _exact_links(nodes, levels[0], threshold)
            counts = links.groupBy("row").agg(F.sum("links").alias("links"))
        roots = connected_components(links.select(F.col("row").alias("src"), F.col("root").alias("dst")))
        roots = roots.withColumnRenamed("node", "row")
        rooted = stored(nodes.join(roots, "row", "left").join(counts, "row", "left")
                        .select("unit", "n", "least", F.coalesce("root", "row").alias("root"),
                                F.coalesce("links", F.lit(0)).alias("links")), "graph-rooted")
        ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "graph-ids")
        known = stored(rooted.join(ids, "root").select("unit", (F.col("links") + F.col("n") - 1).alias("n_links"),
                                                       "component_id"), "graph-labels")
        linked = rows.join(known, "unit").select("vec_id", "n_links", "component_id")
    else:
        linked = rows.where("false").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    alone = rows.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
