"""KPIs and churn breakdowns, each a single aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import number, number_or_null
from churnlens.functions.stats import safe_pct
from churnlens.functions.text import state_label
from churnlens.functions.formats import np_round

KPI_MEANS = [
    ("satisfaccion_promedio", "satisfaccion"),
    ("monto_mensual_promedio", "monto_mensual"),
    ("reclamos_promedio", "reclamos_ultimos_6_meses"),
    ("pagos_atrasados_promedio", "pagos_atrasados"),
    ("dias_sin_uso_promedio", "dias_sin_uso"),
]


def kpis(df: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """The ten dashboard indicators in one aggregate (always one row)."""
    t = number_or_null(df, target)
    churned = F.count_if(t == 1)
    stayed = F.count_if(t == 0)
    valid = F.count_if(t.isin(0.0, 1.0))
    means = [F.coalesce(F.avg(number_or_null(df, c)), F.lit(0.0)).alias(name) for name, c in KPI_MEANS]
    return df.agg(
        F.count(F.lit(1)).alias("total_clientes"),
        stayed.alias("clientes_permanecen"),
        churned.alias("clientes_abandonaron"),
        safe_pct(churned, valid).alias("tasa_abandono"),
        safe_pct(stayed, valid).alias("tasa_retencion"),
        *means)


CATEGORY_SCHEMA = "{c} string, total_clientes bigint, clientes_abandonaron bigint, tasa_abandono double"


def churn_by_category(df: DataFrame, column: str, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Total, churned and rate per trimmed category; rate desc, ties by category asc."""
    if column not in config.GROUPING_COLUMNS or column not in df.columns or target not in df.columns:
        return df.sparkSession.createDataFrame([], CATEGORY_SCHEMA.format(c=column))
    cat = F.trim(F.col(column).cast("string"))
    t = number(df, target)
    return (df.select(cat.alias(column), t.alias("_t"))
            .filter(F.col(column).isNotNull() & (F.col(column) != "") & F.col("_t").isin(0.0, 1.0))
            .groupBy(column)
            .agg(F.count(F.lit(1)).alias("total_clientes"),
                 F.sum("_t").cast("bigint").alias("clientes_abandonaron"))
            .withColumn("tasa_abandono", safe_pct(F.col("clientes_abandonaron"), F.col("total_clientes")))
            .orderBy(F.desc("tasa_abandono"), F.asc(column)))


def churn_by_dimensions(df: DataFrame, columns=config.GROUPING_COLUMNS,
                        target: str = config.TARGET_COLUMN) -> DataFrame:
    """D9 for several dimensions in ONE shuffle: unpivot to (dimension, categoria) first."""
    cols = [c for c in columns if c in config.GROUPING_COLUMNS and c in df.columns]
    t = number(df, target)
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.trim(F.col(c).cast("string")).alias("categoria"))
                      for c in cols])
    return (df.select(t.alias("_t"), F.explode(pairs).alias("p"))
            .select("p.dimension", "p.categoria", "_t")
            .filter(F.col("categoria").isNotNull() & (F.col("categoria") != "") & F.col("_t").isin(0.0, 1.0))
            .groupBy("dimension", "categoria")
            .agg(F.count(F.lit(1)).alias("total_clientes"),
                 F.sum("_t").cast("bigint").alias("clientes_abandonaron"))
            .withColumn("tasa_abandono", safe_pct(F.col("clientes_abandonaron"), F.col("total_clientes"))))


def mean_by_state(df: DataFrame, column: str, target: str = config.TARGET_COLUMN) -> DataFrame:
    """(abandono, estado_abandono, promedio) over rows with target 0/1."""
    if column not in df.columns or target not in df.columns:
        return df.sparkSession.createDataFrame([], "abandono int, estado_abandono string, promedio double")
    t = number(df, target)
    return (df.select(t.alias("_t"), number(df, column).alias("_v"))
            .filter(F.col("_t").isin(0.0, 1.0))
            .groupBy("_t").agg(F.avg("_v").alias("promedio"))
            .select(F.col("_t").cast("int").alias("abandono"), state_label(F.col("_t")).alias("estado_abandono"),
                    "promedio")
            .orderBy("abandono"))


def count_by_state(df: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """(abandono, estado_abandono, total_clientes)."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "abandono int, estado_abandono string, total_clientes bigint")
    t = number(df, target)
    return (df.select(t.alias("_t")).filter(F.col("_t").isin(0.0, 1.0))
            .groupBy("_t").agg(F.count(F.lit(1)).alias("total_clientes"))
            .select(F.col("_t").cast("int").alias("abandono"), state_label(F.col("_t")).alias("estado_abandono"),
                    "total_clientes")
            .orderBy("abandono"))


def global_churn(df: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Customer count and churn percentage (average of the 0/1 target x 100)."""
    return df.agg(F.count(F.lit(1)).alias("total_clientes"),
                  (F.avg(F.col(target).cast("double")) * 100).alias("tasa_abandono"))


def metric_comparison(df: DataFrame, metrics=config.METRIC_COMPARISON,
                      target: str = config.TARGET_COLUMN) -> DataFrame:
    """Mean of four metrics per churn state in one aggregate (Metrica, Estado, Promedio)."""
    present = [(label, c) for label, c in metrics if c in df.columns]
    if not present or target not in df.columns:
        return df.sparkSession.createDataFrame([], "Metrica string, Estado string, Promedio double")
    order = {label: i for i, (label, _) in enumerate(present)}
    items = F.array(*[F.struct(F.lit(label).alias("m"), F.lit(order[label]).alias("o"),
                               number(df, c).alias("v")) for label, c in present])
    t = number(df, target)
    return (df.select(t.alias("_t"), F.explode(items).alias("x"))
            .filter(F.col("_t").isin(0.0, 1.0))
            .groupBy("x.m", "x.o", "_t").agg(F.avg("x.v").alias("p"))
            .orderBy("o", "_t")
            .select(F.col("m").alias("Metrica"), state_label(F.col("_t")).alias("Estado"),
                    np_round(F.col("p"), 2).alias("Promedio")))


def distinct_states(df: DataFrame, state_col: str = "estado_abandono") -> DataFrame:
    """Number of distinct churn states (fewer than two -> not comparable)."""
    return df.agg(F.count_distinct(state_col).alias("estados"),
                  (F.count_distinct(state_col) >= 2).alias("comparable"))
