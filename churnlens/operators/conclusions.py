"""Generated descriptive sentences (top churn category, mean differences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import number
from churnlens.operators.metrics import churn_by_dimensions
from churnlens.functions.formats import fixed2_text


def _py_2dp(c):
    return fixed2_text(c)


def top_rate_sentences(df: DataFrame, topics=config.TOP_RATE_TOPICS) -> DataFrame:
    """H19 for each topic: first row of D9 (rate desc, category asc) as a sentence."""
    cols = [c for c, _ in topics if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "orden int, conclusion string")
    by = churn_by_dimensions(df, cols)
    w = Window.partitionBy("dimension").orderBy(F.desc("tasa_abandono"), F.asc("categoria"))
    label = F.col("dimension")
    pos = F.lit(None).cast("int")
    for i, (c, lab) in enumerate(topics):
        label = F.when(F.col("dimension") == c, F.lit(lab)).otherwise(label)
        pos = F.when(F.col("dimension") == c, F.lit(i)).otherwise(pos)
    template = config.TOP_RATE_SENTENCE
    pre, rest = template.split("{label}")
    mid, rest = rest.split("{value}")
    mid2, post = rest.split("{rate}")
    return (by.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(pos.alias("orden"),
                    F.concat(F.lit(pre), label, F.lit(mid), F.col("categoria"), F.lit(mid2),
                             _py_2dp(F.col("tasa_abandono")), F.lit(post)).alias("conclusion")))


def difference_sentences(df: DataFrame, topics=config.DIFFERENCE_TOPICS,
                         target: str = config.TARGET_COLUMN, first_pos: int = 3) -> DataFrame:
    """mean(churned) - mean(stayed) per metric, only when both states have rows."""
    present = [(c, lab) for c, lab in topics if c in df.columns]
    if not present or target not in df.columns:
        return df.sparkSession.createDataFrame([], "orden int, conclusion string")
    t = number(df, target)
    aggs = [F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1")]
    for i, (c, _) in enumerate(present):
        v = number(df, c)
        aggs += [F.avg(F.when(t == 0, v)).alias(f"m0_{i}"), F.avg(F.when(t == 1, v)).alias(f"m1_{i}")]
    one = df.agg(*aggs)
    pre, rest = config.DIFFERENCE_SENTENCE.split("{label}")
    mid, post = rest.split("{diff}")
    rows = []
    for i, (c, lab) in enumerate(present):
        diff = F.col(f"m1_{i}") - F.col(f"m0_{i}")
        ok = (F.col("n0") > 0) & (F.col("n1") > 0)
        text = F.concat(F.lit(pre + lab + mid), _py_2dp(diff), F.lit(post))
        rows.append(F.struct(F.lit(first_pos + i).alias("orden"), F.when(ok, text).alias("conclusion")))
    return (one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .filter(F.col("conclusion").isNotNull()))


def conclusions(df: DataFrame) -> DataFrame:
    """Up to five sentences (three top categories, two differences), ordered."""
    return top_rate_sentences(df).unionByName(difference_sentences(df)).orderBy("orden")
