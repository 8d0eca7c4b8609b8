"""Exact tree, Newton logistic regression and batched K-Means against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import logistic, model, segment, tree


def rows_for_tree(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rnd.randrange(12) / 4, rnd.gauss(0, 1), rnd.choice("uvwx")
        out.append((c, a, b, int(rnd.random() < (0.8 if (a > 1.2) != (c == "v") else 0.25))))
    return out


def plain_tree(rows, n0, n1, depth, least):
    """Rows (category, a, b, y) -> {leaf number: (rows, positives)} by trying every split."""
    def side(part):
        a, b = float(sum(r[3] == 0 for r in part)) * n1, float(sum(r[3] for r in part)) * n0
        return (a * a + b * b) / (a + b)

    def grow(part, node, level):
        here = {node: (len(part), sum(r[3] for r in part))}
        if level == depth or len({r[3] for r in part}) < 2:
            return here
        tests = [(0, 0.0, c, lambda r, c=c: r[0] == c) for c in sorted({r[0] for r in part})]
        for f in (1, 2):
            values = sorted({r[f] for r in part})
            for x, y in zip(values, values[1:]):
                t = x if (x + y) / 2 >= y else (x + y) / 2
                tests.append((f, t, "", lambda r, f=f, t=t: r[f] > t))
        best = None
        for f, t, c, goes in tests:
            left, right = [r for r in part if not goes(r)], [r for r in part if goes(r)]
            if len(left) >= least and len(right) >= least:
                key = (-(side(left) + side(right)), f, t, c)
                if best is None or key < best[0]:
                    best = key, left, right
        return here if best is None else grow(best[1], 2 * node, level + 1) | grow(best[2], 2 * node + 1, level + 1)

    return grow(rows, 1, 0)


@pytest.mark.parametrize("range_rows,seed", [(10 ** 6, 1), (25, 1), (7, 2)])
def test_tree_equals_trying_every_split(spark, monkeypatch, range_rows, seed):
    monkeypatch.setattr(tree, "RANGE_ROWS", range_rows)  # small: the scan runs over many ranges
    rows = rows_for_tree(240, seed)
    df = spark.createDataFrame(rows, "c string, a double, b double, y int").repartition(5)
    nodes = tree.grow(df, ["c"], ["a", "b"], "y", depth=4, min_leaf=8)
    n1 = sum(r[3] for r in rows)
    leaves = {k: (v.rows, v.positives) for k, v in nodes.items() if v.split is None}
    assert leaves == plain_tree(rows, len(rows) - n1, n1, 4, 8) and len(leaves) > 5
    rules = tree.rules_of(nodes)
    reached = df.select("y", tree.node_column(nodes).alias("k"), tree.probability(rules, lambda c: F.col(c)).alias("p"))
    by_leaf = {r[0]: r[-1] for r in rules}
    assert all(r["p"] == by_leaf[r["k"]] for r in reached.collect())


@pytest.mark.parametrize("rows", [[], [("u", 1.0, 1.0, 1)] * 90, [("u", 1.0, 1.0, k % 2) for k in range(90)]])
def test_trees_without_a_split(spark, rows):
    df = spark.createDataFrame(rows, "c string, a double, b double, y int")
    rules = tree.rules_of(tree.grow(df, ["c"], ["a", "b"], "y"))
    assert len(rules) == 1 and rules[0][:2] == (1, None) and rules[0][6] == len(rows)
    got = {r[0] for r in spark.range(2).select(tree.probability(rules, lambda c: F.col(c))).collect()}
    assert got == {rules[0][-1]}


def test_logistic_gradient_vanishes_and_equals_numpy(spark):
    rows = [(c, a, b, y, 1.0 + (c == "u")) for c, a, b, y in rows_for_tree(300, 3)]
    df = spark.createDataFrame(rows, "c string, a double, b double, y int, s double").withColumn("d", F.upper("c")).repartition(4)
    fitted = logistic.fit(df, ["c", "d"], ["a", "b"], "y", "s")
    assert all(abs(r["gradiente"]) < 1e-8 for r in logistic.gradient(df, fitted, "y", "s").collect())
    one = [np.array([1.0, a, b, *(c == k for k in "uvwx"), *(c == k for k in "uvwx")]) for c, a, b, _, _ in rows]
    beta = np.array([fitted.intercept, fitted.numeric["a"], fitted.numeric["b"], *fitted.categories["c"].values(),
                     *fitted.categories["d"].values()])
    x, y, s = np.stack(one), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    grad = x.T @ (s * (y - 1 / (1 + np.exp(-x @ beta)))) - np.r_[0.0, beta[1:]]
    assert np.abs(grad).max() < 1e-8
    p = df.limit(1).withColumn("c", F.lit("unseen")).select(
        logistic.logistic(fitted.margin(lambda c: F.col(c), lambda c: F.col(c)))).first()[0]
    assert 0 < p < 1


def test_logistic_of_separable_rows_and_too_many_categories(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") > 30).cast("int").alias("y"),
                                F.lit(1.0).alias("s"), F.col("id").cast("string").alias("c"))
    fitted = logistic.fit(df, [], ["a"], "y", "s")
    assert math.isfinite(fitted.numeric["a"]) and fitted.numeric["a"] > 0
    monkeypatch.setattr(logistic, "MAX_FEATURES", 50)
    with pytest.raises(ValueError, match="too many"):
        logistic.fit(df, ["c"], ["a"], "y", "s")


def test_lloyd_ends_at_a_fixed_point_of_least_cost(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(m, 0.6, (70, 2)) for m in ((0, 0), (4, 0), (0, 5), (5, 5))])
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "key string, _z0 double, _z1 double").repartition(3)
    starts = segment._first_centres(df, 4, 42, 6)

    def plain(c):
        while True:
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            if ((new - c) ** 2).sum() <= 1e-12:
                return new, ((x[:, None] - new[None]) ** 2).sum(axis=2).min(axis=1).sum()
            c = new

    ends = [plain(np.array(c)) for c in starts.values()]
    got = np.array(segment.lloyd(df, 4, 42, 6, 300, 1e-12))
    cost = ((x[:, None] - got[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert cost == pytest.approx(min(c for _, c in ends))
    assert segment._first_centres(df.repartition(7), 4, 42, 6) == starts


def test_labels_leave_other_columns_alone(spark):
    rows = [(f"i{k}", *[float(k % 3 * 10 + k % 2)] * 7, k) for k in range(30)]
    df = spark.createDataFrame(rows, "id_cliente string, " + ", ".join(f"{c} double" for c in segment.FEATURES) + ", _z0 int")
    out = segment.kmeans_labels(df, 3, n_init=2)
    assert out.drop("cluster_id").orderBy("id_cliente").collect() == df.orderBy("id_cliente").collect()
    assert {r["cluster_id"]: r["n"] for r in out.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 10}


def test_stored_models_round_trip_and_corrupt_ones_fail(spark, tmp_path):
    from test_segment_risk_model import _planted

    df, path = _planted(spark, 400), str(tmp_path / "m")
    fitted = model.train(df)
    model.save_model(fitted, path)
    loaded, _ = model.load_model(path)
    for a, b in ((fitted.tree, loaded), (fitted.logistic, model.load_logistic(path))):
        assert sorted(map(tuple, model.score(a, df).collect())) == sorted(map(tuple, model.score(b, df).collect()))
    # a null and an unseen category, a null number
    odd = df.limit(3).withColumns({"ciudad": F.lit(None).cast("string"), "monto_mensual": F.lit(None).cast("double"), "plan": F.lit("?")})
    assert model.score(loaded, odd).where("probabilidad_churn IS NULL").count() == 0
    spark.createDataFrame([("{}",)], "metadata string").coalesce(1).write.mode("overwrite").text(path + "/metadata")
    with pytest.raises(ValueError, match="cannot be read"):
        model.load_model(path)
    spark.range(1).write.mode("overwrite").parquet(path + "/rules")
    with pytest.raises(ValueError, match="cannot be read"):
        model.load_model(path)
    (tmp_path / "n").mkdir()
    with pytest.raises(ValueError, match="no rules"):
        model.load_model(str(tmp_path / "n"))
