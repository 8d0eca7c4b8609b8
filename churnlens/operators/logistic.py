"""Logistic regression with balanced class weights and an L2 penalty (C = 1), by Newton steps.

A step needs the gradient and the Gram matrix of the weighted features.  With one-hot categories most of that matrix
is counts: an aggregate gives the numeric block, another one over GROUPING SETS - every categorical column, every pair
of them - the category by number and category by category blocks, both partially summed in every task.
The driver receives at most one row per pair of categories (bounded by ``MAX_FEATURES`` squared, half) and solves
the system.  The intercept is not penalised; categories all keep a coefficient of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Most coefficients: the matrix of a step is held by the driver.
MAX_FEATURES = 2_000
MAX_STEPS = 100
#: Greatest component of the gradient at which the fit ends.
TOLERANCE = 1e-9


@dataclass
class Coefficients:
    intercept: float
    numeric: dict[str, float]
    categories: dict[str, dict[str, float]]

    def margin(self, number, category) -> Column:
        """The linear predictor; ``number(c)`` and ``category(c)`` give the prepared columns. An unseen category adds 0."""
        out = F.lit(self.intercept)
        for c, b in self.numeric.items():
            out = out + number(c) * F.lit(b)
        for c, levels in self.categories.items():
            if levels:
                table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
                out = out + F.coalesce(F.try_element_at(table, category(c)), F.lit(0.0))
        return out


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _step_sums(rows: DataFrame, categories: int, numbers: int, beta: np.ndarray) -> tuple[Row, pa.Table | None]:
    """The sums that gradient and Gram matrix need: numbers and intercept, and by grouping set of the categories.

    Two aggregates over the persisted rows, as the many products of numbers are needed once, not in every set.  The
    coefficients enter as one array, so that every step runs the same compiled code.
    """
    z, c = [f"_z{i}" for i in range(numbers)], [f"_c{i}" for i in range(categories)]
    b = "array(" + ", ".join(f"{float(x)!r}D" for x in beta) + ")"
    margin = " + ".join([f"_b[{numbers}]", *[f"{x} * _b[{i}]" for i, x in enumerate(z)], *[f"_b[{x}]" for x in c]])
    work = (rows.selectExpr("*", f"{b} AS _b").selectExpr(*rows.columns, f"{margin} AS _m")
            .selectExpr("*", "1 / (1 + exp(-_m)) AS _p").selectExpr("*", "_s * (_y - _p) AS _r", "_s * _p * (1 - _p) AS _w"))
    few = ["sum(_w) AS w", "sum(_r) AS r", *[f"sum(_w * {x}) AS w{i}" for i, x in enumerate(z)]]
    # log(1 + e^m) without overflow
    whole = work.selectExpr("sum(_s * (greatest(_m, 0D) - _m * _y + log1p(exp(-abs(_m))))) AS loss", *few,
                            *[f"sum(_r * {x}) AS r{i}" for i, x in enumerate(z)],
                            *[f"sum(_w * {z[i]} * {z[j]}) AS w{i}_{j}" for i in range(numbers) for j in range(i, numbers)]).first()
    if not c:
        return whole, None
    sets = ", ".join(f"({', '.join(x)})" for x in [*([x] for x in c), *combinations(c, 2)])
    return whole, rows.sparkSession.sql(f"SELECT {', '.join(c + few)} FROM {{work}} GROUP BY GROUPING SETS ({sets})", work=work).toArrow()


def fit(train: DataFrame, categorical: list[str], numeric: list[str], label: str, weight: str, penalty: float = 1.0) -> Coefficients:
    """Coefficients that minimise the weighted log-loss plus penalty / 2 times their squares.

    ``train`` holds prepared columns (standardised numbers, texts without nulls); its numbers and the places of its
    categories are persisted for the steps, which read them once each.
    """
    levels = {c: sorted(r[0] for r in train.select(F.col(f"`{c}`")).distinct().limit(MAX_FEATURES + 1).collect()) for c in categorical}
    m = len(numeric)
    place = {(c, v): i for i, (c, v) in enumerate(((c, v) for c in categorical for v in levels[c]), m + 1)}
    size = m + 1 + len(place)
    if size > MAX_FEATURES:
        raise ValueError(f"too many one-hot features for the logistic regression: {size}")
    rows = train.select(
        F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_s"),
        *[F.col(f"`{c}`").alias(f"_z{i}") for i, c in enumerate(numeric)],
        *[F.element_at(F.create_map(*[F.lit(x) for v in levels[c] for x in (v, place[c, v])]), F.col(f"`{c}`")).alias(f"_c{i}")
          if levels[c] else F.lit(None).cast("int").alias(f"_c{i}") for i, c in enumerate(categorical)])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta = _newton(rows, len(categorical), m, size, penalty)
    finally:
        rows.unpersist()
    return Coefficients(float(beta[m]), {c: float(beta[i]) for i, c in enumerate(numeric)},
                        {c: {v: float(beta[place[c, v]]) for v in levels[c]} for c in categorical})


def _newton(rows: DataFrame, categories: int, m: int, size: int, penalty: float) -> np.ndarray:
    ridge = np.full(size, penalty)
    ridge[m] = 0.0
    beta, step, last = np.zeros(size), np.zeros(size), np.inf
    for _ in range(MAX_STEPS):
        gram, grad, loss = np.zeros((size, size)), np.zeros(size), 0.0
        whole, sums = _step_sums(rows, categories, m, beta)
        if sums is not None:
            w, wz = sums["w"].to_numpy(), np.array([sums[f"w{i}"].to_numpy() for i in range(m)]).reshape(m, -1).T
            at = np.stack([sums[f"_c{i}"].fill_null(-1).to_numpy() for i in range(categories)], axis=1)  # -1: summed over
            single = (at >= 0).sum(axis=1) == 1
            pairs = np.sort(at[~single], axis=1)[:, -2:].astype(int)
            if len(pairs):
                gram[pairs[:, 0], pairs[:, 1]] = gram[pairs[:, 1], pairs[:, 0]] = w[~single]
            one = at[single].max(axis=1, initial=-1).astype(int)
            gram[one, one] = gram[one, m] = gram[m, one] = w[single]
            gram[one, :m], gram[:m, one] = wz[single], wz[single].T
            grad[one] = sums["r"].to_numpy()[single]
        if whole["w"] is not None:  # null for an empty table
            loss, gram[m, m], grad[m] = whole["loss"], whole["w"], whole["r"]
            for i in range(m):
                gram[i, m] = gram[m, i] = whole[f"w{i}"]
                grad[i] = whole[f"r{i}"]
                for j in range(i, m):
                    gram[i, j] = gram[j, i] = whole[f"w{i}_{j}"]
        grad -= ridge * beta
        total = loss + float((ridge * beta * beta).sum()) / 2
        if np.abs(grad).max(initial=0.0) < TOLERANCE or np.abs(step).max(initial=0.0) < 1e-13 and np.isfinite(last):
            break
        if total > last + 1e-9 * abs(last):  # overshot: half the step back
            step = step / 2
            beta = beta - step
            continue
        last = total
        step = np.linalg.lstsq(gram + np.diag(ridge), grad, rcond=None)[0]
        beta = beta + step
    return beta


def gradient(rows: DataFrame, fitted: Coefficients, label: str, weight: str, penalty: float = 1.0) -> DataFrame:
    """(variable, valor, gradiente): the penalised gradient at the coefficients, summed anew row by row.

    One aggregate over (variable, category) pairs; a number has valor '' and the intercept variable ''.
    """
    p = logistic(fitted.margin(lambda c: F.col(f"`{c}`"), lambda c: F.col(f"`{c}`")))
    parts = [F.struct(F.lit("").alias("variable"), F.lit("").alias("valor"), F.lit(1.0).alias("x"))]
    parts += [F.struct(F.lit(c).alias("variable"), F.lit("").alias("valor"), F.col(f"`{c}`").alias("x")) for c in fitted.numeric]
    parts += [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("valor"), F.lit(1.0).alias("x")) for c in fitted.categories]
    r = F.col(weight).cast("double") * (F.col(label).cast("double") - p)
    sums = (rows.select(r.alias("_r"), F.explode(F.array(*parts)).alias("f")).groupBy("f.variable", "f.valor")
            .agg(F.sum(F.col("_r") * F.col("f.x")).alias("g")))
    flat = [("", "", 0.0), *((c, "", penalty * b) for c, b in fitted.numeric.items()),
            *((c, v, penalty * b) for c, levels in fitted.categories.items() for v, b in levels.items())]
    shrink = F.broadcast(rows.sparkSession.createDataFrame(flat, "variable string, valor string, b double"))  # MAX_FEATURES rows
    return sums.join(shrink, ["variable", "valor"]).select("variable", "valor", (F.col("g") - F.col("b")).alias("gradiente"))
