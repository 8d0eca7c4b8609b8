"""Near-duplicate operators against brute force."""

import numpy as np
import pytest
import xxhash

from churnlens.llm import flatgraph, graph, simhash, topk


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(docs):
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                                  if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    least = {}
    for (doc_id, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), doc_id) if x is not None], default=None)
    want = sorted(((d, f"{p:016x}", least[r]) for (d, p), r in zip(rows, root)), key=str)
    got = simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    return len(set(root))


def test_simhash_groups(documents, odd_docs, no_docs):
    assert check_simhash(documents) < documents.count()
    check_simhash(odd_docs)
    assert simhash.simhash_groups(no_docs).count() == 0


def test_one_document_of_each_group_stays(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs, no_docs):
        kept = simhash.without_near_copies(docs)
        assert kept.columns == docs.columns
        groups = simhash.simhash_groups(docs)
        assert kept.count() == groups.select("group").distinct().count()
        ids = {r.component_id for r in groups.select("component_id").distinct().collect()}
        assert {r.doc_id for r in kept.collect()} == ids


def test_repeated_rows_and_texts_without_a_shuffle(spark, documents):
    from pyspark.sql import functions as F

    twice = documents.withColumn("lang", F.lit("zz")).unionByName(documents).unionByName(documents)
    left = simhash.without_near_copies(twice.repartition(5))
    once = simhash.without_near_copies(documents)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in once.collect())
    again = simhash.without_near_copies(twice.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, left.collect()))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    maps = documents.withColumn("m", F.create_map(F.lit("a"), "doc_id"))
    assert simhash.without_near_copies(maps.union(maps)).count() == once.count()


@pytest.mark.parametrize("block", [2048, 40])
def test_bit_sliced_links_lose_nothing(spark, block):
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2 ** 63, 8, dtype=np.uint64)
    prints = base[rng.integers(0, 8, 600)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    prints = np.unique(np.r_[prints, base, rng.integers(0, 2 ** 63, 300, dtype=np.uint64)])
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2, 1))
    want = components(len(prints), near.tolist())
    nodes = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    at = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    links = [(at[r.src], at[r.dst]) for r in simhash.linked_prints(nodes, 2, block, 200).collect()]
    assert components(len(prints), links) == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 1), (200, 201)]
    got = {r.node: r.root for r in graph.connected_components(
        spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def vector_rows(rng, n, dim=16):
    base = rng.normal(size=(n // 4, dim))
    v = base[rng.integers(0, len(base), n)] + rng.normal(scale=rng.choice([0.02, 0.08, 0.5], (n, 1)), size=(n, dim))
    rows = [(int(i), [float(np.float32(x)) for x in r], 0, "z") for i, r in enumerate(v)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] + [1.0] * (dim - 1)),
           (n + 4, [None] * dim), (n + 5, [float("inf")] * dim), (None, rows[0][1]), (n + 6, rows[0][1]), (3, rows[3][1]),
           (n + 7, [1e30] * dim), (n + 8, [2e30] * dim), (n + 9, rows[5][1][:dim - 1]), (n + 10, [1e-30] * dim)]
    return rows + [(i, e, 1, "w") for i, e in odd]


def test_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = vector_rows(rng, 700)
    monkeypatch.setattr(flatgraph, "BLOCK", 150)
    monkeypatch.setattr(flatgraph, "CLUSTER_ROWS", 200)
    got = flatgraph.near_copies(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    unit = []
    for _, e, *_ in rows:
        v = np.array([np.nan if x is None else x for x in (e or [0.0])] + [0.0] * (16 - len(e or [0.0])), np.float64)
        ok = e and np.isfinite(v).all() and v.any()
        v = v / np.abs(v).max() if ok else v * 0
        unit.append(v / np.linalg.norm(v) if ok else np.zeros(16))
    cos = np.nan_to_num(np.array(unit) @ np.array(unit).T)
    near = (cos >= 0.95) & ~np.eye(len(rows), dtype=bool)
    root = components(len(rows), np.argwhere(np.triu(near)).tolist())
    least = {}
    for r, x in zip(root, rows):
        least[r] = min([i for i in (least.get(r), x[0]) if i is not None], default=None)
    want = sorted(((x[0], int(near[i].sum()), least[root[i]], x[0] == least[root[i]]) for i, x in enumerate(rows)), key=str)
    have = sorted(map(tuple, got), key=str)
    assert len(have) == len(want)
    found, true = sum(h[1] for h in have), sum(w[1] for w in want)
    assert 0.98 * true <= found <= true
    assert sum(h[2] != w[2] for h, w in zip(have, want)) <= 0.02 * len(want)
    assert flatgraph.near_copies(spark.createDataFrame([], VECTORS)).count() == 0
    alone = flatgraph.near_copies(spark.createDataFrame([(5, None, 1, ""), (None, None, 1, "")], VECTORS)).collect()
    assert sorted(map(tuple, alone), key=str) == [(5, 0, 5, True), (None, 0, None, True)]


def test_low_recall_repeats_with_wider_settings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    seen = []
    monkeypatch.setattr(flatgraph, "audited_recall", lambda *a: seen.append(1) or (0.5 if len(seen) < 3 else 1.0))
    rows = [(i, rng.normal(size=4).tolist(), 0, "") for i in range(50)]
    assert flatgraph.near_copies(spark.createDataFrame(rows, VECTORS)).count() == 50
    assert len(seen) == 3


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_low_recall_or_no_evidence_ends_in_exact_links(spark, monkeypatch, shape):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 24)) if shape == "spread" else np.repeat(rng.normal(size=(6, 24)), 100, 0) * 3 + (
        rng.normal(size=(600, 24)))
    v = np.concatenate([base, base[:60] + rng.normal(scale=0.25, size=(60, 24)) * np.linalg.norm(
        base[:60], axis=1, keepdims=True) / 24 ** 0.5])
    v = np.concatenate([v, np.tile(base[599], (50, 1))])  # a hot vector
    rows = [(i, x.tolist(), 0, "") for i, x in enumerate(v)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    root = components(len(v), np.argwhere(np.triu(near)).tolist())
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    want = [(i, int(near[i].sum()), least[root[i]], least[root[i]] == i) for i in range(len(v))]
    monkeypatch.setattr(flatgraph, "CLUSTER_ROWS", 30)
    monkeypatch.setattr(flatgraph, "BLOCK", 200)
    monkeypatch.setattr(flatgraph, "BEAM", 2)
    monkeypatch.setattr(flatgraph, "ATTEMPTS", 1)
    table = spark.createDataFrame(rows, VECTORS)
    for recall in (0.5, None):
        monkeypatch.setattr(flatgraph, "audited_recall", lambda *a: recall)
        assert sorted(map(tuple, flatgraph.near_copies(table).collect())) == want


def test_audit_counts_every_vertex_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8)
    hot = hot / np.linalg.norm(hot)
    small = rng.normal(size=(40, 8))
    v = np.concatenate([small, small * 1.0 + 1e-3, [hot], [hot + 1e-4]])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, x.tolist(), 10_000 if i >= 80 else 1) for i, x in enumerate(v)],
                                  "row long, unit array<double>, n long")
    true = ((v @ v.T >= 0.95) & ~np.eye(len(v), dtype=bool)).sum(axis=1)
    known = spark.createDataFrame([(i, 10_000, int(true[i])) for i in (80, 81)], "row long, links long, others long")
    assert flatgraph.audited_recall(nodes, known, 0.95) == pytest.approx(2 / 82)
    monkeypatch.setattr(flatgraph, "AUDIT_ROWS", 1)
    monkeypatch.setattr(flatgraph, "AUDIT_ROUNDS", 2)
    assert flatgraph.audited_recall(nodes, known, 0.95) is None


def test_exact_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = vector_rows(rng, 500)
    rows = [r for r in rows if r[0] not in (507, 508)] + [(600, [-0.001] * 16, 0, ""), (650, [1e30] * 16, 0, "")]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "ROUTED_SHARDS", 4)
    got = topk.top_inner_products(spark.createDataFrame(rows, VECTORS), k=4, every=20, sample=60, shard_rows=50)
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, *_ in rows
            if i is not None and e is not None and None not in e and np.isfinite(np.array(e)).all()]
    want, asked = set(), {}
    for i, e in fine:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, e), e)
    for i, e in asked.items():
        scored = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(e, x)))), j)
                        for j, x in fine if j != i)
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:4])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_inner_products(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, "")], VECTORS)
    assert [tuple(r) for r in topk.top_inner_products(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_rare_links_stay_on_the_graph(spark, monkeypatch):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(20_000, 48))
    v[:100] = v[100:200] + rng.normal(scale=0.2, size=(100, 48))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = [(i, int(j)) for a in range(0, len(v), 2000) for i, row in enumerate(unit[a:a + 2000] @ unit.T, a)
            for j in np.flatnonzero(row >= 0.95) if i != j]
    assert 100 <= len(near) <= 400
    recalls = []
    audit = flatgraph.audited_recall
    monkeypatch.setattr(flatgraph, "audited_recall", lambda *a: recalls.append(audit(*a)) or recalls[-1])
    monkeypatch.setattr(flatgraph, "AUDIT_ROUNDS", 2)
    monkeypatch.setattr(flatgraph, "_exact_links", lambda *a: pytest.fail("all pairs were compared"))
    table = spark.createDataFrame([(i, x.tolist(), 0, "") for i, x in enumerate(v)], VECTORS)
    got = flatgraph.near_copies(table).collect()
    assert len(got) == len(v) and recalls[-1] >= 0.98
    truth = np.bincount([i for i, _ in near], minlength=len(v))
    assert all(r.n_links <= truth[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * len(near)


def test_cells_grow_by_levels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(flatgraph, "LEVEL_CENTROIDS", 8)
    levels = flatgraph.fit_levels(v[:800], 200)
    assert [len(c) for c in levels] == [8, 8, 4]
    sums = (levels[0][:, None, None] + levels[1][None, :, None] + levels[2]).reshape(256, 12)
    cells = flatgraph.nearest_cells(v, levels, 300, 9.0)
    assert all(len(set(c)) == len(c) == 256 for c in cells)
    few = flatgraph.nearest_cells(v, levels, 3, 0.1)
    far = ((v[:, None] - sums[None]) ** 2).sum(axis=2)
    best = np.take_along_axis(far, np.array([c[0] for c in few])[:, None], 1)[:, 0]
    assert all(1 <= len(c) <= 3 for c in few) and best.mean() < 1.5 * far.min(axis=1).mean()
    rows = vector_rows(rng, 600)
    monkeypatch.setattr(flatgraph, "LEVEL_CENTROIDS", 2)
    monkeypatch.setattr(flatgraph, "CLUSTER_ROWS", 90)
    got = flatgraph.near_copies(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows) and sum(r.n_links > 0 for r in got) > 100


def test_planted_partners_lie_in_range(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(50, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, unit array<double>")
    got = flatgraph.planted_partners(nodes, 0.95, 40).collect()
    assert len({r.row for r in got}) == 40 and all(r.row < 0 and r.n == 0 for r in got)
    assert all(0.95 <= v[-1 - r.row] @ np.array(r.unit) <= 0.9751 for r in got)
