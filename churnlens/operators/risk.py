"""Risk levels, risk distribution and summary over scored customers.

Input is any frame with (id_cliente, probabilidad_churn, nivel_riesgo) — the
output of ``model.score`` or of ``baseline_scores``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.bins import risk_level

from churnlens.functions.stats import safe_pct
from churnlens.functions.formats import fmt_prediction_pct, np_round


def with_risk(scores: DataFrame, prob_col: str = "probabilidad_churn") -> DataFrame:
    """H14 then H15: bucket on the unrounded probability, round to 4 (half-even) after."""
    p = F.col(prob_col)
    return scores.withColumns({"nivel_riesgo": risk_level(p), prob_col: np_round(p, 4)})


def baseline_scores(view: DataFrame, by=("ciudad", "plan"), fit_on: DataFrame | None = None,
                    target: str = config.TARGET_COLUMN) -> DataFrame:
    """A deterministic scorer: each customer gets the observed churn rate of its (by...) cell.

    Rates are fitted on ``fit_on`` (default: ``view``) and applied to
    ``view``; a cell never seen scores 0.0.  One grouped aggregate joined back
    on the cell keys; the number of cells is bounded by the category domains.
    """
    keys = list(by)
    src = fit_on if fit_on is not None else view
    rates = (src.filter(F.col(target).isin(0, 1))
             .groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias("probabilidad_churn")))
    scored = view.select(config.ID_COLUMN, *keys).join(rates, keys, "left")
    return with_risk(scored.select(config.ID_COLUMN,
                                   F.coalesce("probabilidad_churn", F.lit(0.0)).alias("probabilidad_churn")))


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Customers per level over the fixed domain bajo, medio, alto (absent -> 0)."""
    spark = scores.sparkSession
    domain = spark.createDataFrame([(i, lvl) for i, lvl in enumerate(config.RISK_LEVELS)],
                                   "orden int, nivel_riesgo string")
    counts = scores.groupBy("nivel_riesgo").agg(F.count(F.lit(1)).alias("clientes"))
    return (F.broadcast(domain).join(counts, "nivel_riesgo", "left")
            .select("orden", "nivel_riesgo", F.coalesce("clientes", F.lit(0)).cast("bigint").alias("clientes"))
            .orderBy("orden"))


def risk_summary(scores: DataFrame) -> DataFrame:
    """D28 + D29 + tiles: one aggregate row with counts, high-risk % and mean probability %."""
    lvl = F.col("nivel_riesgo")
    p = F.col("probabilidad_churn").cast("double")
    n = F.count(F.lit(1))
    high_pct = safe_pct(F.count_if(lvl == "alto"), n)
    mean_pct = F.coalesce(F.avg(F.when(~F.isnan(p), p)) * 100, F.lit(0.0))
    return scores.agg(
        n.alias("clientes_evaluados"),
        F.count_if(lvl == "alto").alias("riesgo_alto"),
        F.count_if(lvl == "medio").alias("riesgo_medio"),
        F.count_if(lvl == "bajo").alias("riesgo_bajo"),
        high_pct.alias("porcentaje_riesgo_alto"),
        mean_pct.alias("probabilidad_promedio"),
    ).withColumns({"porcentaje_riesgo_alto_texto": fmt_prediction_pct(F.col("porcentaje_riesgo_alto")),
                   "probabilidad_promedio_texto": fmt_prediction_pct(F.col("probabilidad_promedio"))})


def risk_table(scores: DataFrame, levels=config.RISK_DEFAULT_FILTER) -> DataFrame:
    """B12 + F3: chosen levels, probability descending (id as tiebreak)."""
    return (scores.filter(F.col("nivel_riesgo").isin(list(levels)))
            .orderBy(F.desc("probabilidad_churn"), F.asc(config.ID_COLUMN)))
