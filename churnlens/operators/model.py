"""Split, preprocessing, the two churn classifiers, evaluation, persistence and scoring.

The preprocessing statistics (modes, exact medians, population mean and deviation of the imputed columns) come from
ONE aggregate over the training split.  The tree (``operators.tree``) is exact and becomes a rule table, the logistic
regression (``operators.logistic``) is fitted by Newton steps; both score with one generated expression, so scoring is
a projection without a side table.  An unseen category matches no rule and adds nothing to the logistic margin.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.stats import safe_ratio
from churnlens.operators import logistic as newton, tree as exact_tree
from churnlens.operators.risk import with_risk
from churnlens.functions.formats import np_round
from churnlens.operators.quantiles import exact_medians, exact_quantiles

LABEL, WEIGHT = "_label", "_weight"
#: Most distinct values of a categorical feature: its index is kept by the driver and sent to all tasks.
MAX_CATEGORIES = 10_000


# --------------------------------------------------------------------------- K5 split
def split_hash(seed: int = config.MODEL_SEED, id_col: str = config.ID_COLUMN) -> Column:
    """A number from 0 to 2**32 - 1 that depends on seed and id only (md5, the same under any engine)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10
                  ).cast("double")


def split_flag(df: DataFrame, seed: int = config.MODEL_SEED, test_fraction: float = config.TEST_FRACTION,
               id_col: str = config.ID_COLUMN, target: str = config.TARGET_COLUMN) -> Column:
    """K5: True for the test split: the rows up to the hash's quantile ``test_fraction`` *within each class*.

    Reproducible under any partitioning; each class gives its share to the row.  The quantiles (one number per
    class) come from three light aggregates.  Rows without a valid target are not in the test split.
    """
    h = split_hash(seed, id_col)
    cls = F.col(target).cast("int")
    limits = exact_quantiles(df, {str(v): F.when(cls == v, h) for v in config.TARGET_VALUES}, [test_fraction])
    flag = F.lit(False)
    for v in config.TARGET_VALUES:
        limit = limits[str(v)][0]
        if limit is not None:
            flag = F.when(cls == v, h < limit + 0.5).otherwise(flag)
    return F.coalesce(flag, F.lit(False))


def features_of(df: DataFrame, categorical=config.MODEL_CATEGORICAL, numeric=config.MODEL_NUMERIC,
                strict: bool = True) -> tuple[list[str], list[str]]:
    """Explicit feature lists; id, name, target, segment and predictions never enter.

    A listed feature that is absent raises, unless ``strict`` is off; then it
    is skipped.
    """
    missing = [c for c in categorical + numeric if c not in df.columns]
    if strict and missing:
        raise ValueError(f"the view lacks model features: {missing}")
    excluded = set(config.PREDICTION_EXCLUDED) | {"segmento", "probabilidad_churn", "nivel_riesgo"}
    cats = [c for c in categorical if c in df.columns and c not in excluded]
    nums = [c for c in numeric if c in df.columns and c not in excluded]
    if not cats and not nums:
        raise ValueError("no feature is left for the model")
    return cats, nums


# --------------------------------------------------------------------------- K6 preprocessing
def most_frequent(df: DataFrame, name: str) -> str | None:
    """The most frequent non-null value as text, ties to the smallest; a partial count, then the top one."""
    top = (df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "v").limit(1).first())
    return top["v"] if top else None


def fit_preprocessing(train: DataFrame, cats: list[str], nums: list[str]) -> dict:
    """Modes, exact medians and population mean/std after imputation, from one aggregate row.

    The row is model state (a few numbers per feature), so it is collected.
    """
    aggs = []
    for c in nums:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"sd_{c}")]
    aggs.append(F.count(F.lit(1)).alias("_n"))
    aggs += [F.approx_count_distinct(F.col(c).cast("string")).alias(f"k_{c}") for c in cats]
    row = train.agg(*aggs).first().asDict()
    wide = [c for c in cats if row[f"k_{c}"] > MAX_CATEGORIES]
    if wide:
        raise ValueError(f"too many categories for one-hot features: {wide}")
    meds = exact_medians(train, {c: F.col(c).cast("double") for c in nums}) if nums else {}
    row.update({f"med_{c}": meds[c] for c in nums})
    n = row["_n"]
    stats = {"modes": {c: most_frequent(train, c) for c in cats}, "medians": {}, "means": {}, "scales": {}}
    for c in nums:
        med = row[f"med_{c}"] if row[f"med_{c}"] is not None else 0.0
        k_obs = row[f"n_{c}"]
        mean_obs = row[f"mean_{c}"] if row[f"mean_{c}"] is not None else med
        var_obs = (row[f"sd_{c}"] or 0.0) ** 2
        k_miss = n - k_obs
        mean = (k_obs * mean_obs + k_miss * med) / n if n else 0.0
        var = ((k_obs * (var_obs + (mean_obs - mean) ** 2) + k_miss * (med - mean) ** 2) / n) if n else 0.0
        sd = var ** 0.5
        stats["medians"][c] = float(med)
        stats["means"][c] = float(mean)
        stats["scales"][c] = float(sd) if sd > 1e-12 else 1.0  # constant column -> centred only
    return stats


def imputed_category(c: str, stats: dict) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(stats["modes"][c] or ""))


def imputed_number(c: str, stats: dict) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(stats["medians"][c]))


def standardised(c: str, stats: dict) -> Column:
    return (imputed_number(c, stats) - F.lit(stats["means"][c])) / F.lit(stats["scales"][c])


# --------------------------------------------------------------------------- K7 class weights, models
def class_weights(train: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class."""
    counts = train.groupBy(F.col(target).cast("int").alias(target)).agg(F.count(F.lit(1)).alias("n_clase"))
    # the window spans one row per class (two rows), never the data
    total = F.sum("n_clase").over(Window.partitionBy())
    k = F.count(F.lit(1)).over(Window.partitionBy())
    return counts.select(target, "n_clase", (total / (k * F.col("n_clase"))).alias("peso"))


def _weighted(train: DataFrame, target: str) -> tuple[DataFrame, float]:
    """Attach label and balanced weight; the class domain is tiny, so weights are literals."""
    rows = train.groupBy(F.col(target).cast("int").alias("c")).count().collect()
    n = sum(r["count"] for r in rows)
    w = {r["c"]: n / (len(rows) * r["count"]) for r in rows}
    weight = F.lit(0.0)
    for c, v in w.items():
        weight = F.when(F.col(target).cast("int") == c, F.lit(v)).otherwise(weight)
    out = train.withColumns({LABEL: F.col(target).cast("double"), WEIGHT: weight})
    return out, float(sum(w[r["c"]] * r["count"] for r in rows))


@dataclass
class TreeModel:
    """The rule table of an exact tree (depth 4, 30 rows a leaf, balanced weights) and its imputation."""

    rules: list[tuple]
    stats: dict

    def probability(self) -> Column:
        return exact_tree.probability(self.rules, lambda c: imputed_category(c, self.stats) if c in self.stats["modes"]
                                      else imputed_number(c, self.stats))


@dataclass
class LogisticModel:
    """Coefficients over standardised numbers and one-hot categories, and the statistics behind them."""

    coefficients: newton.Coefficients
    stats: dict

    def probability(self) -> Column:
        return newton.logistic(self.coefficients.margin(lambda c: standardised(c, self.stats),
                                                        lambda c: imputed_category(c, self.stats)))


# --------------------------------------------------------------------------- K9 scoring, D35 evaluation
def score(model: TreeModel | LogisticModel, df: DataFrame, features: list[str] | None = None,
          id_col: str = config.ID_COLUMN) -> DataFrame:
    """K9: (id_cliente, probabilidad_churn rounded 4, nivel_riesgo on the unrounded value)."""
    if df.isEmpty():  # one-row probe, not a count
        raise ValueError("nothing to score: the input is empty")
    if id_col not in df.columns:
        raise ValueError("the rows to score need an id_cliente")
    missing = [c for c in features or [*model.stats["modes"], *model.stats["medians"]] if c not in df.columns]
    if missing:
        raise ValueError(f"the model was trained with columns that are absent: {missing}")
    return with_risk(df.select(F.col(id_col), model.probability().alias("probabilidad_churn")))


def predictions(model: TreeModel | LogisticModel, df: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """The input of ``evaluate``: label and predicted class (1 above one half)."""
    return df.select(F.col(target).cast("double").alias(LABEL), (model.probability() > 0.5).cast("double").alias("prediction"))


def evaluate(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Confusion counts, accuracy / recall / precision / F1 (rounded 4) and majority baseline, one agg."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    tp, tn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 0))
    fp, fn = F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    one = pred.agg(tp.alias("vp"), tn.alias("vn"), fp.alias("fp"), fn.alias("fn"), F.count(F.lit(1)).alias("n"),
                   F.avg(y.cast("double")).alias("_rate"))
    acc = safe_ratio(F.col("vp") + F.col("vn"), F.col("n"))
    rec = safe_ratio(F.col("vp"), F.col("vp") + F.col("fn"))
    prec = safe_ratio(F.col("vp"), F.col("vp") + F.col("fp"))
    f1 = safe_ratio(2 * F.col("vp"), 2 * F.col("vp") + F.col("fp") + F.col("fn"))
    return one.select("vp", "vn", "fp", "fn", "n",
                      np_round(acc, 4).alias("accuracy"), np_round(rec, 4).alias("recall"),
                      np_round(prec, 4).alias("precision"), np_round(f1, 4).alias("f1"),
                      np_round(F.greatest(F.col("_rate"), 1 - F.col("_rate")), 4).alias("linea_base"))


# --------------------------------------------------------------------------- K8 training orchestration
@dataclass
class TrainedModels:
    tree: TreeModel | None
    logistic: LogisticModel | None
    metadata: dict = field(default_factory=dict)


def train(view: DataFrame, strict_features: bool = True, fit_logistic: bool = True, fit_tree: bool = True,
          target: str = config.TARGET_COLUMN) -> TrainedModels:
    """K8: split, fit preprocessing + tree + logistic on the training rows, evaluate on the test rows.

    The labelled rows (id, features and target only) are persisted once, the prepared training rows once more: the
    statistics, the levels of the tree and the Newton steps read them; they are released afterwards.  Only the models
    asked for are fitted.
    """
    cats, nums = features_of(view, strict=strict_features)
    keep = [c for c in dict.fromkeys([config.ID_COLUMN] + cats + nums + [target])]
    base = view.filter(F.col(target).isin(0, 1)).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    rows = None
    try:
        # the split's quantiles and all fits read the persisted rows: the view is computed once
        flagged = base.withColumn("_test", split_flag(base))
        train_df, _ = _weighted(flagged.filter(~F.col("_test")), target)
        test_df = flagged.filter(F.col("_test"))
        stats = fit_preprocessing(train_df, cats, nums)
        rows = train_df.select(LABEL, WEIGHT, *[imputed_category(c, stats).alias(c) for c in cats],
                               *[imputed_number(c, stats).alias(c) for c in nums]).persist(StorageLevel.MEMORY_AND_DISK)
        tree = TreeModel(exact_tree.rules_of(exact_tree.grow(rows, cats, nums, LABEL)), stats) if fit_tree else None
        logistic = LogisticModel(newton.fit(scaled_rows(rows, cats, nums, stats), cats, nums, LABEL, WEIGHT), stats) \
            if fit_logistic else None
        # one pass over the test rows for both models
        none = {k: None for k in ("accuracy", "recall", "precision", "f1", "linea_base")}
        m_tree, m_log = (evaluate(predictions(m, test_df, target)).first().asDict() if m is not None else none
                         for m in (tree, logistic))
    finally:
        base.unpersist()
        if rows is not None:
            rows.unpersist()
    meta = {
        "modelo_nombre": config.MODEL_NAME, "version": config.MODEL_VERSION,
        "features": cats + nums, "categoricas": cats, "clase_positiva": 1, "indice_clase_positiva": 1,
        "clases": [0, 1], "fecha_entrenamiento": _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S"),
        "metricas": {"arbol": {k: m_tree[k] for k in ("accuracy", "recall", "precision", "f1")},
                     "regresion_logistica": {k: m_log[k] for k in ("accuracy", "recall", "precision", "f1")},
                     "linea_base": m_tree["linea_base"] if tree is not None else m_log["linea_base"]},
        "preprocesamiento": stats,
    }
    return TrainedModels(tree, logistic, meta)


def scaled_rows(rows: DataFrame, cats: list[str], nums: list[str], stats: dict) -> DataFrame:
    """Label, weight, categories and standardised numbers of imputed training rows."""
    return rows.select(LABEL, WEIGHT, *[F.col(f"`{c}`") for c in cats], *[standardised(c, stats).alias(c) for c in nums])


# --------------------------------------------------------------------------- A13 persistence
def save_model(models: TrainedModels, path: str) -> None:
    """The served tree as a rule table, and a JSON of metadata, statistics and logistic coefficients beside it."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(models.tree.rules, exact_tree.RULE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        os.path.join(path, "rules"))
    meta = models.metadata | {"coeficientes": asdict(models.logistic.coefficients) if models.logistic else None}
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False, default=str),)], "metadata string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "metadata"))


def load_model(path: str) -> tuple[TreeModel, dict]:
    """Missing model -> FileNotFoundError; unreadable, without rules or statistics, or with other columns -> ValueError."""
    spark = SparkSession.getActiveSession()
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"there is no model under {path}")
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "rules"))):
        raise ValueError("the stored model has no rules")
    try:
        columns = [c.split()[0] for c in exact_tree.RULE_SCHEMA.replace("array<string>", "list").split(", ")]
        rules = [tuple(r) for r in spark.read.parquet(os.path.join(path, "rules")).select(*columns).collect()]  # 16 leaves
        meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
        stats = meta["preprocesamiento"]
        lacking = {r[1] for r in rules if r[1] is not None} - {*stats["modes"], *stats["medians"]}
        if not rules or lacking:
            raise ValueError(f"rules are missing, or features without statistics: {lacking}")
    except Exception as exc:  # noqa: BLE001
        raise ValueError(f"the model under {path} cannot be read: {exc}") from exc
    return TreeModel(rules, stats), meta


def load_logistic(path: str) -> LogisticModel:
    """The logistic regression stored beside the served tree; ValueError if none was fitted."""
    _, meta = load_model(path)
    if not meta.get("coeficientes"):
        raise ValueError("the stored model has no logistic regression")
    return LogisticModel(newton.Coefficients(**meta["coeficientes"]), meta["preprocesamiento"])


def generate_scores(model_path: str, view: DataFrame) -> tuple[DataFrame, dict]:
    """Load the served model and score every row of the view."""
    model, meta = load_model(model_path)
    return score(model, view, meta.get("features")), meta
