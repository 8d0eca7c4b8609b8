"""K-Means segmentation and per-cluster summaries.

* K1/K2: coercion, exact-median imputation and population z-scores; the
  per-feature statistics (a handful of numbers) come from two aggregate rows
  and are applied as literals.
* K3: Lloyd's passes for all starts at once, one aggregate of (start, cluster)
  sums a pass over one persisted frame; the start of least cost is kept; labels
  are made canonical by sorting the centres (first coordinate, then the next).
* D23-D26, E2, H22 work on any frame with a ``cluster_id`` column; the
  summaries have one row per cluster, so the trait ranking windows span k rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import number
from churnlens.functions.stats import safe_pct
from churnlens.operators.quantiles import exact_medians

FEATURES = config.SEGMENT_FEATURES


def cluster_label(cluster_id: Column) -> Column:
    """H18: 'Clúster ' + (id + 1)."""
    return F.concat(F.lit(config.CLUSTER_PREFIX), (cluster_id + 1).cast("string"))


# --------------------------------------------------------------------------- K1, K2
def missing_features(df: DataFrame | None) -> list[str]:
    if df is None:
        return list(FEATURES)
    return [c for c in FEATURES if c not in df.columns]


@dataclass
class Scaler:
    medians: dict
    means: dict
    scales: dict


def fit_scaler(df: DataFrame) -> Scaler:
    """K1 + K2 statistics: exact medians, then mean / population std of the imputed columns.

    All passes read one persisted projection of the seven coerced features,
    so the input (e.g. the analytic view with its joins) is computed once.
    """
    missing = missing_features(df)
    if missing:
        raise ValueError("columns needed for segments are absent: " + ", ".join(missing))
    proj = df.select(*[number(df, c).alias(c) for c in FEATURES]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = proj.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n_{c}") for c in FEATURES]).first()
        if first["_n"] == 0:
            raise ValueError("there are no customers to segment")
        for c in FEATURES:
            if first[f"n_{c}"] == 0:
                raise ValueError("a column needed for segments has no number: "
                                 + c)
        medians = {c: float(v) for c, v in exact_medians(proj, {c: F.col(c) for c in FEATURES}).items()}
        imputed = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in FEATURES}
        second = proj.agg(*[F.avg(imputed[c]).alias(f"m_{c}") for c in FEATURES],
                          *[F.stddev_pop(imputed[c]).alias(f"s_{c}") for c in FEATURES]).first()
    finally:
        proj.unpersist()
    means = {c: float(second[f"m_{c}"]) for c in FEATURES}
    scales = {c: float(second[f"s_{c}"]) for c in FEATURES}
    return Scaler(medians, means, scales)


def scaled_columns(df: DataFrame, sc: Scaler) -> dict[str, Column]:
    """z = (x - mean) / std on the imputed value; a zero-variance feature scales to 0."""
    out = {}
    for c in FEATURES:
        x = F.coalesce(number(df, c), F.lit(sc.medians[c]))
        s = sc.scales[c]
        out[f"z_{c}"] = (x - F.lit(sc.means[c])) / F.lit(s) if s > 0 else F.lit(0.0)
    return out


def scaled_features(df: DataFrame, sc: Scaler | None = None, id_col: str = config.ID_COLUMN) -> DataFrame:
    sc = sc or fit_scaler(df)
    z = scaled_columns(df, sc)
    return df.select(F.col(id_col), *[e.alias(n) for n, e in z.items()])


# --------------------------------------------------------------------------- K3, K4
def _first_centres(points: DataFrame, k: int, seed: int, n_init: int) -> dict[int, list[list[float]]]:
    """For every start the points of the k smallest hashes of (seed + start, id): the same on any layout of the rows."""
    starts = points.selectExpr("*", f"explode(sequence(0, {n_init - 1})) AS start").withColumn(
        "h", F.md5(F.concat((F.col("start") + seed).cast("string"), F.lit(":"), "key")))
    z = [c for c in points.columns if c.startswith("_z")]
    order = Window.partitionBy("start").orderBy("h", "key", *z)  # cut to k rows a task before the shuffle
    rows = starts.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k).orderBy("start", "no").collect()
    out: dict[int, list[list[float]]] = {}
    for r in rows:
        out.setdefault(r["start"], []).append([r[c] for c in z])
    return out


def _distances(k: int, width: int) -> list[str]:
    """Squared distances of a point (_z0, _z1 ...) to the k centres in the array ``c``."""
    return [" + ".join(f"(_z{i} - c[{j * width + i}]) * (_z{i} - c[{j * width + i}])" for i in range(width)) for j in range(k)]


def _nearest(k: int) -> str:
    """The nearest centre by _d0, _d1 ..., ties to the first."""
    return "CASE " + " ".join(f"WHEN _d{j} <= _least THEN {j}" for j in range(k)) + " END"


def _array(values: list[list[float]]) -> str:
    return "array(" + ", ".join(f"{float(x)!r}D" for v in values for x in v) + ")"


def _assigned(points: DataFrame, centres: dict[int, list[list[float]]], k: int, width: int) -> DataFrame:
    """Every point once for each start, with its nearest centre and the squared distance."""
    starts = "array(" + ", ".join(f"struct({s} AS start, {_array(c)} AS c)" for s, c in centres.items()) + ")"
    met = points.selectExpr("*", f"inline({starts})").selectExpr(
        "*", *[f"{d} AS _d{j}" for j, d in enumerate(_distances(k, width))])
    least = "_d0" if k == 1 else "least(" + ", ".join(f"_d{j}" for j in range(k)) + ")"
    return met.selectExpr("*", f"{least} AS _least").selectExpr("*", f"{_nearest(k)} AS _cluster")


def lloyd(points: DataFrame, k: int, seed: int, n_init: int, max_iter: int, tol: float) -> list[list[float]]:
    """K-Means centres of (key, _z0, _z1 ...): all starts advance together, the one of least cost is returned.

    A pass is one aggregate of (start, cluster) sums, a few rows a task; starts whose centres moved by at most ``tol``
    (squared) rest.  A cluster that lost all points keeps its centre.
    """
    width = sum(c.startswith("_z") for c in points.columns)
    centres = _first_centres(points, k, seed, n_init)
    sums = [F.expr(f"avg(_z{i})").alias(f"m{i}") for i in range(width)]
    moving = set(centres)
    for _ in range(max_iter):
        now = {s: centres[s] for s in sorted(moving)}
        new = {s: [list(c) for c in v] for s, v in now.items()}
        for r in _assigned(points, now, k, width).groupBy("start", "_cluster").agg(*sums).collect():
            new[r["start"]][r["_cluster"]] = [r[f"m{i}"] for i in range(width)]
        for s, v in new.items():
            if sum((a - b) ** 2 for x, y in zip(v, centres[s], strict=True) for a, b in zip(x, y, strict=True)) <= tol:
                moving.discard(s)
            centres[s] = v
        if not moving:
            break
    cost = {r["start"]: r["cost"] for r in
            _assigned(points, centres, k, width).groupBy("start").agg(F.sum("_least").alias("cost")).collect()}
    return centres[min(cost, key=lambda s: (cost[s], s))]


def kmeans_labels(df: DataFrame, n_clusters: int = 3, random_state: int = 42, n_init: int = 10,
                  sc: Scaler | None = None, max_iter: int = 300, tol: float = 1e-4,
                  id_col: str = config.ID_COLUMN) -> DataFrame:
    """K3: ``df`` plus ``cluster_id`` (0..k-1, in the order of the centres) from the best of ``n_init`` starts.

    The first centres depend on ids and ``random_state`` only, so a repeated call gives the same labels.
    """
    sc = sc or fit_scaler(df)
    z = scaled_columns(df, sc)
    key = F.col(id_col).cast("string") if id_col in df.columns else F.lit("")
    points = df.select(F.coalesce(key, F.lit("")).alias("key"), *[e.alias(f"_z{i}") for i, e in enumerate(z.values())])
    points = points.persist(StorageLevel.MEMORY_AND_DISK)  # every pass reads it
    try:
        n = points.count()
        if n < n_clusters:
            raise ValueError(f"{n_clusters} clusters need at least as many customers; there are {n}")
        centres = sorted(lloyd(points, n_clusters, random_state, n_init, max_iter, tol))
    finally:
        points.unpersist()
    # the label is one expression over z-scores that live in a struct, so no column of df can clash
    zs = F.struct(*[e.alias(f"z{i}") for i, e in enumerate(z.values())])
    out = df.withColumn("cluster_id", zs)
    far = [" + ".join(f"(cluster_id.z{i} - {c!r}D) * (cluster_id.z{i} - {c!r}D)" for i, c in enumerate(v)) for v in centres]
    out = out.withColumn("cluster_id", F.expr("array(" + ", ".join(far) + ")"))
    return out.withColumn("cluster_id", F.expr("cast(array_position(cluster_id, array_min(cluster_id)) - 1 AS int)"))


def segment(df: DataFrame, n_clusters: int = 3, random_state: int = 42, n_init: int = 10) -> dict:
    """K4: labels, counts, summary, churn rate per cluster and descriptions (all DataFrames).

    The results share persisted frames (memory, then disk); call ``["release"]()`` when done with them.
    """
    if df is None:
        raise ValueError("segmentation needs a DataFrame")
    # the input and the labels are computed once for the fits and all five results
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    labelled = kmeans_labels(kept, n_clusters, random_state, n_init)
    seg = labelled.withColumn("cluster", cluster_label(F.col("cluster_id"))).persist(StorageLevel.MEMORY_AND_DISK)
    summary = cluster_summary(seg)

    def release() -> None:
        seg.unpersist()
        kept.unpersist()

    return {"clientes_segmentados": seg, "conteo_clusters": cluster_counts(seg), "resumen_clusters": summary,
            "tasa_abandono_clusters": cluster_churn(seg), "descripciones": describe_clusters(summary),
            "release": release}


# --------------------------------------------------------------------------- D23-D26
def _with_label(seg: DataFrame) -> DataFrame:
    cid = F.col("cluster_id").cast("int")
    seg = seg.withColumn("cluster_id", cid)
    return seg if "cluster" in seg.columns else seg.withColumn("cluster", cluster_label(cid))


def cluster_counts(seg: DataFrame) -> DataFrame:
    """(cluster_id, cluster, total_clientes) by cluster id."""
    return (_with_label(seg).groupBy("cluster_id", "cluster").agg(F.count(F.lit(1)).alias("total_clientes"))
            .orderBy("cluster_id"))


def cluster_summary(seg: DataFrame) -> DataFrame:
    """Size and feature means in original units (missing values skipped, not imputed)."""
    s = _with_label(seg)
    present = [c for c in FEATURES if c in s.columns]
    return (s.groupBy("cluster_id", "cluster")
            .agg(F.count(F.lit(1)).alias("total_clientes"), *[F.avg(number(s, c)).alias(c) for c in present])
            .orderBy("cluster_id"))


def cluster_churn(seg: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Valid targets only; total, churned and rate per cluster."""
    s = _with_label(seg)
    t = number(s, target)
    return (s.select("cluster_id", "cluster", t.alias("_t")).filter(F.col("_t").isin(0.0, 1.0))
            .groupBy("cluster_id", "cluster")
            .agg(F.count(F.lit(1)).alias("total_clientes"), F.sum("_t").cast("bigint").alias("clientes_abandonaron"))
            .withColumn("tasa_abandono", safe_pct(F.col("clientes_abandonaron"), F.col("total_clientes")))
            .orderBy("cluster_id"))


def fixed_domain_counts(counts: DataFrame, n_clusters: int = 3) -> DataFrame:
    """Clusters 1..k always present (0 when absent), joined on the label."""
    domain = counts.sparkSession.range(n_clusters).select(cluster_label(F.col("id")).alias("cluster"),
                                                          F.col("id").alias("_o"))
    return (F.broadcast(domain).join(counts.select("cluster", "total_clientes"), "cluster", "left")
            .select("cluster", F.coalesce("total_clientes", F.lit(0)).cast("bigint").alias("total_clientes"), "_o")
            .orderBy("_o").drop("_o"))


# --------------------------------------------------------------------------- E2, H22
def cluster_traits(summary: DataFrame) -> DataFrame:
    """Per cluster, up to three 'mayor/menor promedio de X' traits in feature order."""
    present = [c for c in FEATURES if c in summary.columns]
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(present)])
    long = summary.select("cluster_id", F.explode(items).alias("x")).select("cluster_id", "x.*")
    w = Window.partitionBy("feature")  # k rows per feature
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    long = long.withColumns({"_lo": lo, "_hi": hi})
    usable = F.col("v").isNotNull() & F.col("_lo").isNotNull() & (F.col("_lo") != F.col("_hi"))
    pre_hi, post_hi = config.TRAIT_HIGH.split("{feature}")
    pre_lo, post_lo = config.TRAIT_LOW.split("{feature}")
    text = (F.when(usable & (F.col("v") == F.col("_hi")), F.concat(F.lit(pre_hi), "feature", F.lit(post_hi)))
            .when(usable & (F.col("v") == F.col("_lo")), F.concat(F.lit(pre_lo), "feature", F.lit(post_lo))))
    traits = (long.withColumn("t", text).filter(F.col("t").isNotNull())
              .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts")))
    return (summary.select("cluster_id").join(traits, "cluster_id", "left")
            .select("cluster_id",
                    F.coalesce(F.transform(F.slice(F.col("ts"), 1, config.MAX_TRAITS), lambda s: s["t"]),
                               F.array().cast("array<string>")).alias("rasgos")))


def describe_clusters(summary: DataFrame) -> DataFrame:
    """One neutral sentence per cluster (cluster_id, descripcion)."""
    tr = cluster_traits(summary)
    s = _with_label(summary).join(tr, "cluster_id", "left")
    with_t = config.CLUSTER_WITH_TRAITS
    a, rest = with_t.split("{cluster}")
    b, rest = rest.split("{total}")
    c, d = rest.split("{traits}")
    without = config.CLUSTER_WITHOUT_TRAITS
    a2, rest2 = without.split("{cluster}")
    b2, c2 = rest2.split("{total}")
    total = F.col("total_clientes").cast("bigint").cast("string")
    sentence = F.when(F.size("rasgos") > 0,
                      F.concat(F.lit(a), "cluster", F.lit(b), total, F.lit(c), F.array_join("rasgos", ", "), F.lit(d))
                      ).otherwise(F.concat(F.lit(a2), "cluster", F.lit(b2), total, F.lit(c2)))
    return s.select("cluster_id", sentence.alias("descripcion")).orderBy("cluster_id")


def rule_segments(view: DataFrame) -> DataFrame:
    """A deterministic segmentation (recency bands of ``dias_sin_uso``) for SQL-checkable reports.

    0: used within 30 days, 1: within 120 days, 2: longer or unknown.
    """
    d = F.col("dias_sin_uso")
    cid = F.when(d <= 30, 0).when(d <= 120, 1).otherwise(2)
    return view.withColumn("cluster_id", cid.cast("int")).withColumn("cluster", cluster_label(F.col("cluster_id")))
