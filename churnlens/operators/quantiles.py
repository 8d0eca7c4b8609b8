"""Exact, interpolated quantiles that stay bounded at any scale.

Spark's exact ``percentile`` keeps a value -> count map per group, and the
final merge of a *global* group holds every distinct value: fine for ages or
counts, fatal for a money column with billions of distinct values.  Here:

1. one pass: ``percentile_approx`` at q +- 2/accuracy brackets the exact
   order statistics (its rank error is at most n/accuracy);
2. one pass: rows below each bracket and inside it are counted;
3. one pass: exact ``percentile`` over the rows *inside* the bracket only,
   at the fraction that lands on the global position (n-1)*q.

The exact map therefore holds at most ~4n/accuracy distinct values (ties
compress further), and the answer equals the interpolated quantile of all
rows (pandas ``median`` / ``quantile``, DuckDB ``quantile_cont``).  If a
bracket ever missed the position, that column falls back to the plain
exact percentile.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
#: Rows that a bracket may hold; larger inputs get a finer sketch.
MAX_BRACKET_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float],
                    accuracy: int | None = None) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles ``qs`` of every column expression (NULLs skipped)."""
    names = list(columns)
    # the three passes read only the quantile columns: project them once and keep that
    # projection (memory, spilling to disk) for the passes; lost blocks are recomputed
    proj = df.select(*[columns[c].cast("double").alias(f"_q{i}") for i, c in enumerate(names)])
    proj = proj.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(proj, {c: F.col(f"_q{i}") for i, c in enumerate(names)}, qs, accuracy)
    finally:
        proj.unpersist()


def _exact_quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float],
                     accuracy: int | None) -> dict[str, list[float | None]]:
    names = list(columns)
    counts = df.agg(*[F.count(columns[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
    n = {c: counts[f"n{i}"] for i, c in enumerate(names)}
    out = {c: [None] * len(qs) for c in names}
    open_ = [(c, j) for c in names if n[c] for j in range(len(qs))]
    # the sketch is as fine as the rows need: a bracket holds about MAX_BRACKET_ROWS rows at most
    accuracy = accuracy or min(2 ** 31 - 1, max(DEFAULT_ACCURACY, 4 * max([0, *n.values()]) // MAX_BRACKET_ROWS))
    margin = 2.0 / accuracy
    while open_:
        found, missed = _bracketed(df, columns, qs, n, open_, accuracy, margin)
        for (c, j), v in found.items():
            out[c][j] = v
        open_, margin = missed, 2 * margin  # a bracket that missed its rank is widened and tried again
    return out


def _bracketed(df: DataFrame, columns: dict[str, Column], qs: list[float], n: dict[str, int],
               wanted: list[tuple[str, int]], accuracy: int, margin: float) -> tuple[dict, list]:
    """Quantiles (column, index) whose bracket around the sketch's value holds their rank; and those missed."""
    names = list(dict.fromkeys(c for c, _ in wanted))
    probes = sorted({min(1.0, max(0.0, qs[j] + s * margin)) for _, j in wanted for s in (-1.0, 1.0)})
    first = df.agg(*[F.percentile_approx(columns[c], probes, accuracy).alias(f"a{i}")
                     for i, c in enumerate(names)]).first()
    brackets, aggs = {}, []
    for k, (c, j) in enumerate(wanted):
        approx = dict(zip(probes, first[f"a{names.index(c)}"]))
        lo, hi = (approx[min(1.0, max(0.0, qs[j] + s * margin))] for s in (-1.0, 1.0))
        brackets[c, j] = (lo, hi)
        aggs += [F.count_if(columns[c] < F.lit(lo)).alias(f"b{k}"),
                 F.count_if(columns[c].between(F.lit(lo), F.lit(hi))).alias(f"m{k}")]
    second = df.agg(*aggs).first()
    third, held, missed = [], [], []
    for k, (c, j) in enumerate(wanted):
        below, inside = second[f"b{k}"], second[f"m{k}"]
        pos = (n[c] - 1) * qs[j] - below
        if inside < 1 or not 0 <= pos <= inside - 1:
            missed.append((c, j))
            continue
        x, (lo, hi) = columns[c], brackets[c, j]
        frac = 0.0 if inside == 1 else min(1.0, pos / (inside - 1))
        third.append(F.percentile(F.when(x.between(F.lit(lo), F.lit(hi)), x), F.lit(frac)).alias(f"v{len(held)}"))
        held.append((c, j))
    row = df.agg(*third).first() if third else []
    return dict(zip(held, row)), missed


def exact_medians(df: DataFrame, columns: dict[str, Column], accuracy: int | None = None) -> dict:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5], accuracy).items()}
