"""Structural gate and quality report, each one aggregate pass.

The reference returns nested dicts; here the structural verdict is a one-row
DataFrame and the quality report a long DataFrame
``(orden, chequeo, columna, n, mensaje)`` where ``mensaje`` is set on the
rows that are warnings.  Counting uses ``count_if`` inside a single ``agg``
(map-side partial aggregation, no per-check pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import config
from churnlens.functions.coerce import number

IGNORED = ("_src", "_pos", "_sobrante")


def data_columns(df: DataFrame, ignore=IGNORED) -> list[str]:
    return [c for c in df.columns if c not in ignore]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (what a pandas reader calls missing)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def not_convertible(df: DataFrame, name: str) -> Column:
    """D18 (validator flavour): present but not a number (so ``''`` counts)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.lit(False)
    return F.col(name).isNotNull() & number(df, name).isNull()


def duplicate_ids(df: DataFrame, name: str) -> DataFrame:
    """One row ``dup``: rows beyond the first per raw id; all NULL ids count as one value.

    A narrow aggregate of its own, so that the other counters are not shuffled per distinct id.
    """
    return (df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("dup")))


def _fmt(template: str, **kw) -> Column:
    """Fill ``{n}`` (a Column) and plain-text keys into a fixed message."""
    text = template
    for k, v in kw.items():
        if not isinstance(v, Column):
            text = text.replace("{" + k + "}", str(v))
    if "{n}" not in text:
        return F.lit(text)
    pre, post = text.split("{n}")
    return F.concat(F.lit(pre), kw["n"].cast("string"), F.lit(post))


def structure_verdict(df: DataFrame, ignore=IGNORED) -> DataFrame:
    """V1: one row (es_valido, errores, n_errores, filas, columnas).

    Missing columns are a plan-time list difference; "no rows" and "id
    entirely blank" come from one aggregate.
    """
    cols = data_columns(df, ignore)
    present = set(cols)
    idc, tgt = config.ID_COLUMN, config.TARGET_COLUMN
    missing = [c for c in config.REQUIRED_COLUMNS if c not in present]
    aggs = [F.count(F.lit(1)).alias("filas")]
    if idc in present:
        raw = F.col(idc).cast("string")
        aggs += [F.count(raw).alias("_id_nonnull"),
                 F.count_if(raw.isNull() | (F.trim(raw) != "")).alias("_id_nonblank")]
    one = df.agg(*aggs)
    errors = [F.when(F.col("filas") == 0, F.lit(config.MSG_NO_ROWS))]
    if missing:
        errors.append(F.lit(config.MSG_MISSING_REQUIRED + ", ".join(missing)))
    if idc not in present:
        errors.append(F.lit(config.MSG_NO_ID))
    else:
        errors.append(F.when((F.col("_id_nonnull") == 0) | (F.col("_id_nonblank") == 0),
                             F.lit(config.MSG_EMPTY_ID)))
    if tgt not in present:
        errors.append(F.lit(config.MSG_NO_TARGET))
    errs = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return one.select(
        (F.size(errs) == 0).alias("es_valido"),
        F.array_join(errs, " | ").alias("errores"),
        F.size(errs).alias("n_errores"),
        F.col("filas"),
        F.lit(len(cols)).cast("bigint").alias("columnas"))


def quality_report(df: DataFrame, ignore=IGNORED) -> DataFrame:
    """V2: the non-blocking quality report as long rows: one aggregate of counters, one of repeated ids.

    Rows: ``filas``, ``columnas``, ``faltantes_total``, ``duplicados_id`` always;
    ``faltantes`` per column with n > 0; warnings (``mensaje`` set) for missing
    values, duplicate ids, non-numeric values, invalid targets, negatives,
    satisfaction and age out of range, each only when n > 0.
    """
    cols = data_columns(df, ignore)
    present = set(cols)
    idc, tgt = config.ID_COLUMN, config.TARGET_COLUMN
    numeric = [c for c in config.NUMERIC_COLUMNS if c in present]
    # every numeric column is coerced once, in a projection the aggregates share
    x = df.select(*cols, *[number(df, c).alias(f"__n_{c}") for c in numeric])

    def num(c: str):
        return F.col(f"__n_{c}")

    aggs = [F.count(F.lit(1)).alias("filas")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"m{i}"))
    for i, c in enumerate(numeric):
        text_like = not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))
        nn = (F.col(c).isNotNull() & num(c).isNull()) if text_like else F.lit(False)
        aggs.append(F.count_if(nn).alias(f"nn{i}"))
    if tgt in present:
        aggs.append(F.count_if(F.col(tgt).isNotNull()
                               & ~F.coalesce(num(tgt).isin(*[float(v) for v in config.TARGET_VALUES]),
                                             F.lit(False))).alias("badt"))
    nonneg = [c for c in config.NON_NEGATIVE_COLUMNS if c in present]
    for i, c in enumerate(nonneg):
        aggs.append(F.count_if(num(c) < 0).alias(f"neg{i}"))
    if "satisfaccion" in present:
        s = num("satisfaccion")
        aggs.append(F.count_if((s < config.SATISFACTION_MIN) | (s > config.SATISFACTION_MAX)).alias("sat"))
    if "edad" in present:
        a = num("edad")
        aggs.append(F.count_if((a < config.AGE_MIN_REASONABLE) | (a > config.AGE_MAX_REASONABLE)).alias("age"))
    one = x.agg(*aggs)
    dup = duplicate_ids(df, idc).scalar() if idc in present else F.lit(0).cast("bigint")
    one = one.withColumn("dup", dup)

    rows = []

    def row(check: str, column, n: Column, message: Column | None, keep: Column | None):
        rows.append(F.struct(
            F.lit(len(rows)).alias("orden"), F.lit(check).alias("chequeo"),
            F.lit(column).cast("string").alias("columna"), n.cast("bigint").alias("n"),
            (message if message is not None else F.lit(None).cast("string")).alias("mensaje"),
            (keep if keep is not None else F.lit(True)).alias("_keep")))

    total_missing = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0).cast("bigint"))
    row("filas", None, F.col("filas"), None, None)
    row("columnas", None, F.lit(len(cols)), None, None)
    for i, c in enumerate(cols):
        row("faltantes", c, F.col(f"m{i}"), None, F.col(f"m{i}") > 0)
    row("faltantes_total", None, total_missing, None, None)
    row("duplicados_id", None, F.col("dup"), None, None)
    row("advertencia_faltantes", None, total_missing, _fmt(config.MSG_MISSING_TOTAL, n=total_missing),
        total_missing > 0)
    row("advertencia_duplicados", idc, F.col("dup"), _fmt(config.MSG_DUPLICATE_IDS, n=F.col("dup")),
        F.col("dup") > 0)
    for i, c in enumerate(numeric):
        n = F.col(f"nn{i}")
        row("no_numericos", c, n, _fmt(config.MSG_NOT_NUMERIC, col=c, n=n), n > 0)
    if tgt in present:
        row("abandono_invalido", tgt, F.col("badt"), F.lit(config.MSG_BAD_TARGET), F.col("badt") > 0)
    for i, c in enumerate(nonneg):
        n = F.col(f"neg{i}")
        row("negativos", c, n, _fmt(config.MSG_NEGATIVE, col=c, n=n), n > 0)
    if "satisfaccion" in present:
        row("satisfaccion_fuera_rango", "satisfaccion", F.col("sat"),
            _fmt(config.MSG_SATISFACTION_RANGE, n=F.col("sat")), F.col("sat") > 0)
    if "edad" in present:
        row("edad_fuera_rango", "edad", F.col("age"), _fmt(config.MSG_AGE_RANGE, n=F.col("age")),
            F.col("age") > 0)
    return (one.select(F.explode(F.array(*rows)).alias("r"))
            .filter("r._keep").select("r.orden", "r.chequeo", "r.columna", "r.n", "r.mensaje"))


def validate(df: DataFrame, ignore=IGNORED) -> tuple[DataFrame, DataFrame | None]:
    """V3: structural verdict, and the quality report only when the structure passes.

    The gate needs the verdict on the driver (one aggregate row).
    """
    verdict = structure_verdict(df, ignore)
    ok = verdict.select("es_valido").first()[0]
    return verdict, (quality_report(df, ignore) if ok else None)


def frame_shape(df: DataFrame, ignore=IGNORED) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.lit(len(data_columns(df, ignore))).cast("bigint").alias("columnas"))
