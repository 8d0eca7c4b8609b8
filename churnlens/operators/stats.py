"""Pearson matrix (pairwise complete), correlation with the target, box-plot statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import number
from churnlens.functions.stats import direction_of
from churnlens.operators.quantiles import exact_quantiles


def _pearson_sql(a: str, b: str) -> str:
    """Pairwise-complete Pearson r of columns a, b as one SQL aggregate expression.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI for a constant column; built from
    population moments with ``try_divide`` it yields NULL instead.
    """
    both = f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN `{a}` END", f"CASE WHEN {both} THEN `{b}` END"
    den = f"stddev_pop({x}) * stddev_pop({y})"
    return f"try_divide(covar_pop({x}, {y}), CASE WHEN {den} > 0 THEN {den} END)"


def correlation_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long Pearson matrix (variable_x, variable_y, pos_x, pos_y, coeficiente).

    ONE aggregate pass gives the non-null count of every column and all n(n-1)/2 pairs with pairwise-complete
    masks (NULL for a constant column, not a division error).  Its single row is read, columns without a number
    are left out afterwards, and the matrix (a few cells per column) is returned as rows.
    """
    present = columns if columns is not None else [c for c in config.CORRELATION_VARIABLES if c in df.columns]
    if len(present) < 2:
        raise ValueError("At least two variables are needed for correlations.")
    num = df.select(*[number(df, c).alias(c) for c in present])
    one = num.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(present)],
                  *[F.expr(_pearson_sql(a, present[j])).alias(f"r_{i}_{j}")
                    for i, a in enumerate(present) for j in range(i, len(present))]).first()
    used = [i for i in range(len(present)) if one[f"n_{i}"] > 0]
    if len(used) < 2:
        raise ValueError("At least two variables with numbers are needed for correlations.")
    cells = []
    for x, i in enumerate(used):
        for y, j in enumerate(used):
            r = one[f"r_{min(i, j)}_{max(i, j)}"]
            cells.append((present[i], present[j], x, y, r if i != j or r is None else 1.0))
    return df.sparkSession.createDataFrame(
        cells, "variable_x string, variable_y string, pos_x int, pos_y int, coeficiente double")


def correlation_with_target(matrix: DataFrame, target: str = config.TARGET_COLUMN,
                            labels=config.CORRELATION_VARIABLES) -> DataFrame:
    """(variable, coeficiente, direccion) vs the target, |r| desc, stable by position."""
    label = F.col("variable_x")
    for k, v in labels.items():
        label = F.when(F.col("variable_x") == k, F.lit(v)).otherwise(label)
    return (matrix.filter((F.col("variable_y") == target) & (F.col("variable_x") != target)
                          & F.col("coeficiente").isNotNull())
            .orderBy(F.desc(F.abs("coeficiente")), F.asc("pos_x"))
            .select(label.alias("variable"), "coeficiente", direction_of(F.col("coeficiente")).alias("direccion")))


def boxplot_stats(points: DataFrame, variable: str) -> DataFrame:
    """Quartiles (interpolated), 1.5 IQR fences, whiskers and outlier counts per churn state.

    ``points`` is the output of ``explore.boxplot_input``.  Quartiles are
    exact per state via the bounded bracket method (``operators.quantiles``),
    one conditional column per (fixed) target label, so both states share the
    same passes.  Whiskers and outliers come from one grouped pass after a
    broadcast of the (two-row) fence table.
    """
    spark = points.sparkSession
    rows = []
    v = F.col(variable).cast("double")
    # one conditional column per state: both states share the same three passes
    per_state = {label: F.when(F.col("estado_abandono") == label, v) for label in config.TARGET_LABELS.values()}
    quart = exact_quantiles(points, per_state, [0.25, 0.5, 0.75])
    for label, q in quart.items():
        if q[0] is not None:
            rows.append((label, float(q[0]), float(q[1]), float(q[2])))
    q = (spark.createDataFrame(rows, "estado_abandono string, q1 double, mediana double, q3 double")
         .withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("limite_inferior", F.col("q1") - 1.5 * F.col("iqr"))
         .withColumn("limite_superior", F.col("q3") + 1.5 * F.col("iqr")))
    inside = v.between(F.col("limite_inferior"), F.col("limite_superior"))
    w = (points.join(F.broadcast(q.select("estado_abandono", "limite_inferior", "limite_superior")),
                     "estado_abandono")
         .groupBy("estado_abandono")
         .agg(F.count(F.lit(1)).alias("n"),
              F.min(F.when(inside, v)).alias("bigote_inferior"),
              F.max(F.when(inside, v)).alias("bigote_superior"),
              F.count_if(~inside).alias("atipicos")))
    return (q.join(w, "estado_abandono")
            .select("estado_abandono", "n", "q1", "mediana", "q3", "iqr", "limite_inferior", "limite_superior",
                    "bigote_inferior", "bigote_superior", "atipicos")
            .withColumn("variable", F.lit(variable)))


def boxplot_outliers(points: DataFrame, stats: DataFrame, variable: str) -> DataFrame:
    """The outlier points (estado_abandono, valor) outside the fences."""
    fences = F.broadcast(stats.select("estado_abandono", "limite_inferior", "limite_superior"))
    v = F.col(variable)
    return (points.join(fences, "estado_abandono")
            .filter(~v.between(F.col("limite_inferior"), F.col("limite_superior")))
            .select("estado_abandono", v.alias("valor")))
