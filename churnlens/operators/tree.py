"""An exact decision tree, grown level by level, and its rule table.

Every level is one job over the training rows, for all open nodes at once.  A numeric feature's values are summed per
(node, value) and scanned in order with running class counts, so every midpoint between neighbouring values is a
candidate and nothing is binned.  The scan runs in two steps: values lie in ranges (edges from a sketch of the
feature, about ``RANGE_ROWS`` rows each), ranges are summed, and a value adds its range's offset to the running count
inside it, so no task sorts a whole feature.  A categorical feature offers each of its values against the rest.

The split with the greatest weighted Gini gain wins; ties go to the first feature, the smallest threshold, the smallest
category.  Scores are computed from whole class counts in one fixed formula, so they do not depend on the order of
rows.  A node stays a leaf at the depth limit, if it is pure, or if no split leaves ``min_leaf`` rows on both sides.

The fitted tree is a relation: one row per leaf and feature with the range or categories that lead there.  Scoring
is one expression generated from it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config

#: Rows that a range of a feature's values holds, about; the edges are a sketch's quantiles.
RANGE_ROWS = 1_000_000
RULE_SCHEMA = ("hoja int, variable string, desde double, hasta double, es string, no_es array<string>, filas long, "
               "positivos long, probabilidad double")


@dataclass(frozen=True)
class Split:
    """Rows go right if the number is above ``threshold``, or the text equals ``category``."""

    feature: str
    threshold: float | None
    category: str | None

    def right(self) -> Column:
        x = F.col(f"`{self.feature}`")
        return x > F.lit(self.threshold) if self.category is None else x.eqNullSafe(F.lit(self.category))


@dataclass
class Node:
    rows: int
    positives: int
    split: Split | None = None


def node_column(nodes: dict[int, Node], node: int = 1) -> Column:
    """The node (root 1, children 2n and 2n + 1) that a row reaches."""
    split = nodes[node].split
    if split is None:
        return F.lit(node)
    return F.when(split.right(), node_column(nodes, 2 * node + 1)).otherwise(node_column(nodes, 2 * node))


def _edges(rows: DataFrame, numeric: list[str], first: int, n: int) -> dict[int, list[float]]:
    """Edges of the ranges of every numeric feature, by the feature's number."""
    ranges = math.ceil(n / RANGE_ROWS)
    if ranges < 2 or not numeric:
        return {}
    at = [i / ranges for i in range(1, ranges)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{c}`"), at, 10 * ranges).alias(f"e{i}") for i, c in enumerate(numeric)]).first()
    return {first + i: sorted(set(found[f"e{i}"])) for i, c in enumerate(numeric)}


def _side(rows: Column, positives: Column, n0: int, n1: int) -> Column:
    """What a side adds to the score: its balanced class weights squared over their sum."""
    a0, a1 = (rows - positives).cast("double") * F.lit(float(n1)), positives.cast("double") * F.lit(float(n0))
    return (a0 * a0 + a1 * a1) / (a0 + a1)


def _value_sums(open_rows: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """(node, feature, x or cat, rows, pos): the counts of every value of every feature in every open node."""
    cells = [F.struct(F.lit(i).alias("feature"), F.lit(None).cast("double").alias("x"), F.col(f"`{c}`").alias("cat"))
             for i, c in enumerate(categorical)]
    cells += [F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").alias("x"), F.lit(None).cast("string").alias("cat"))
              for i, c in enumerate(numeric, len(categorical))]
    long = open_rows.select("_node", "_y", F.explode(F.array(*cells)).alias("p")).where("p.x IS NOT NULL OR p.cat IS NOT NULL")
    return (long.groupBy("_node", "p.feature", "p.x", "p.cat")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("_y").alias("pos")))


def _scanned(sums: DataFrame, edges: dict[int, list[float]]) -> DataFrame:
    """Adds the counts up to each value (r, p) and the next value of its feature in its node.

    With edges the scan has two steps, so that a task sorts one range of a feature; without, one range holds all.
    """
    if not any(edges.values()):
        inside = Window.partitionBy("_node", "feature").orderBy("x", "cat")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        return sums.withColumns({"r": F.sum("rows").over(upto), "p": F.sum("pos").over(upto), "next": F.lead("x").over(inside)})
    span = F.lit(0)
    for i, e in edges.items():
        if e:
            span = F.when(F.col("feature") == i, F.size(F.filter(F.lit(e), lambda y: y < F.col("x")))).otherwise(span)
    sums = sums.withColumn("span", span)
    in_order = Window.partitionBy("_node", "feature").orderBy("span")  # a row per range
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    spans = (sums.groupBy("_node", "feature", "span").agg(F.sum("rows").alias("a"), F.sum("pos").alias("b"), F.min("x").alias("least"))
             .select("_node", "feature", "span", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("rows_before"),
                     F.coalesce(F.sum("b").over(before), F.lit(0)).alias("pos_before"),
                     F.lead("least").over(in_order).alias("next_span")))
    inside = Window.partitionBy("_node", "feature", "span").orderBy("x", "cat")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    scan = sums.withColumns({"r": F.sum("rows").over(upto), "p": F.sum("pos").over(upto), "next": F.lead("x").over(inside)})
    return scan.join(spans, ["_node", "feature", "span"]).withColumns({
        "r": F.col("r") + F.col("rows_before"), "p": F.col("p") + F.col("pos_before"), "next": F.coalesce("next", "next_span")})


def grow(train: DataFrame, categorical: list[str], numeric: list[str], label: str,
         depth: int = config.TREE_MAX_DEPTH, min_leaf: int = config.TREE_MIN_LEAF) -> dict[int, Node]:
    """The exact tree of ``train`` (imputed features, label 0 or 1), by node number."""
    spark = train.sparkSession
    rows = train.select(F.col(label).cast("long").alias("_y"), *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical],
                        *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    nodes = {1: Node(n, n1)}
    edges = _edges(rows, numeric, len(categorical), n)
    features = categorical + numeric
    for level in range(depth):
        open_ = [k for k in nodes if k >= 1 << level and 0 < nodes[k].positives < nodes[k].rows and nodes[k].rows >= 2 * min_leaf]
        if not open_:
            break
        reached = rows.withColumn("_node", node_column(nodes)).where(F.col("_node").isin(open_))
        all_rows, all_pos = (F.element_at(F.create_map(*[F.lit(x) for k in open_ for x in (k, getattr(nodes[k], part))]), F.col("_node"))
                             for part in ("rows", "positives"))  # 2^level entries
        is_text, middle = F.col("cat").isNotNull(), (F.col("x") + F.col("next")) / 2
        splits = _scanned(_value_sums(reached, categorical, numeric), edges).where(is_text | F.col("next").isNotNull()).select(
            "_node", "feature", "cat", F.when(middle >= F.col("next"), F.col("x")).otherwise(middle).alias("threshold"),
            F.when(is_text, all_rows - F.col("rows")).otherwise(F.col("r")).alias("left_rows"),
            F.when(is_text, all_pos - F.col("pos")).otherwise(F.col("p")).alias("left_pos"),
            all_rows.alias("_rows"), all_pos.alias("_pos"))
        right_rows, right_pos = F.col("_rows") - F.col("left_rows"), F.col("_pos") - F.col("left_pos")
        scored = (splits.where((F.col("left_rows") >= min_leaf) & (right_rows >= min_leaf))
                  .withColumn("score", _side(F.col("left_rows"), F.col("left_pos"), n - n1, n1) + _side(right_rows, right_pos, n - n1, n1)))
        best = Window.partitionBy("_node").orderBy(F.col("score").desc(), "feature", "threshold", "cat")  # cut to a row a task
        for r in scored.withColumn("_no", F.row_number().over(best)).where("_no = 1").collect():
            k = r["_node"]
            nodes[k].split = Split(features[r["feature"]], r["threshold"], r["cat"])
            nodes[2 * k] = Node(r["left_rows"], r["left_pos"])
            nodes[2 * k + 1] = Node(nodes[k].rows - r["left_rows"], nodes[k].positives - r["left_pos"])
    return nodes


def rules_of(nodes: dict[int, Node]) -> list[tuple]:
    """The rule table: a row per leaf and feature on its path (a lone root has one row without feature)."""
    n, n1 = nodes[1].rows, nodes[1].positives
    out = []
    for k, node in sorted(nodes.items()):
        if node.split is not None:
            continue
        limits: dict[str, list] = {}
        for step in range(k.bit_length() - 1, 0, -1):
            split, right = nodes[k >> step].split, (k >> (step - 1)) & 1
            low, high, is_, not_ = limits.get(split.feature, [None, None, None, []])
            if split.category is not None:
                is_, not_ = (split.category, not_) if right else (is_, [*not_, split.category])
            elif right:
                low = split.threshold if low is None else max(low, split.threshold)
            else:
                high = split.threshold if high is None else min(high, split.threshold)
            limits[split.feature] = [low, high, is_, not_]
        a0, a1 = float(node.rows - node.positives) * n1, float(node.positives) * (n - n1)
        p = a1 / (a0 + a1) if a0 + a1 else 0.0
        out += [(k, f, *limits[f], node.rows, node.positives, p) for f in limits] or [
            (k, None, None, None, None, [], node.rows, node.positives, p)]
    return out


def probability(rules: list, value) -> Column:
    """One expression over the rule table; ``value(feature)`` gives the imputed column of a feature."""
    leaves: dict[int, list] = {}
    for r in rules:
        leaves.setdefault(r[0], []).append(r)
    out = F.lit(None).cast("double")
    for parts in leaves.values():
        holds = F.lit(True)
        for _, feature, low, high, is_, not_, *_rest in parts:
            if feature is None:
                continue
            x = value(feature)
            if low is not None:
                holds = holds & (x > F.lit(low))
            if high is not None:
                holds = holds & (x <= F.lit(high))
            if is_ is not None:
                holds = holds & x.eqNullSafe(F.lit(is_))
            for c in not_:
                holds = holds & ~x.eqNullSafe(F.lit(c))
        out = F.when(holds, F.lit(parts[0][-1])).otherwise(out)
    return out
