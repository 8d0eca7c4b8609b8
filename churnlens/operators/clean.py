"""Keep-first de-duplication, the cleaning pipeline and its audit report.

Stage order is the reference's: ids (normalise, drop blank, keep first) ->
text -> numeric coercion -> valid ranges -> drop invalid target -> impute ->
final types -> derived columns.  Every stage is a column expression over one
*staged* frame that carries per-row flags, so the whole audit report and the
imputation medians come from ONE aggregate, and the cleaned rows from one
filter + projection of the same frame.

Scale notes
-----------
* Keep-first needs an explicit input order (``_src``, ``_pos``; see
  ``sources.intake``).  The first position per id is a partial aggregate
  (``min(struct)``), joined back on (id, position): a hot id's rows hash over
  many partitions instead of landing in one window task.
* Medians are exact and interpolated, computed over surviving rows only,
  with the bounded bracket method of ``operators.quantiles`` (three light
  aggregate passes; no global value histogram).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import config
from churnlens.functions.bins import age_group, flag_positive, satisfaction_level, tenure_group
from churnlens.functions.coerce import number
from churnlens.functions.text import basic_text, title_case
from churnlens.operators.quantiles import exact_medians

ORDER = ("_src", "_pos")


def order_key(df: DataFrame, order=ORDER) -> Column:
    """One totally ordered, hash-aggregable key for the input order.

    Two integral columns (source index, position) pack exactly into a
    ``decimal(38,0)``: ``min`` over it runs as a hash aggregate, while ``min``
    over a struct or a string falls back to a sort-based aggregate.
    """
    types = dict(df.dtypes)
    if len(order) == 2 and all(types.get(c) in ("tinyint", "smallint", "int", "bigint") for c in order):
        d = "decimal(38,0)"
        return F.col(order[0]).cast(d) * F.lit(Decimal(10 ** 19)).cast(d) + F.col(order[1]).cast(d)
    return F.struct(*order)


def flag_first(df: DataFrame, id_col: str = config.ID_COLUMN, order=ORDER) -> DataFrame:
    """E1 flags: id normalised (H2); ``_blank`` and ``_first`` (first occurrence in input order).

    ``order`` columns must be unique per row.  The first position per id is
    a partial (map-side) aggregate; joining it back on (id, position) hashes
    a hot id's rows over many partitions.
    """
    x = df.withColumn(id_col, basic_text(F.col(id_col))).withColumn("_okey", order_key(df, order))
    firsts = (x.filter(F.col(id_col) != "")
              .groupBy(id_col).agg(F.min("_okey").alias("_okey"))
              .withColumn("_first", F.lit(True)))
    return (x.join(firsts, [id_col, "_okey"], "left")
            .withColumn("_blank", F.col(id_col) == "")
            .withColumn("_first", F.coalesce(F.col("_first"), F.lit(False)))
            .drop("_okey"))


def dedupe_first(df: DataFrame, id_col: str = config.ID_COLUMN, order=ORDER) -> DataFrame:
    """Normalised ids, blank ids removed, first occurrence (input order) kept."""
    return flag_first(df, id_col, order).filter(~F.col("_blank") & F.col("_first")).drop("_blank", "_first")


def clean_texts(df: DataFrame) -> DataFrame:
    """H3: name basic-normalised (blank -> default); categories title-cased (blank -> 'No informado')."""
    out = {}
    if "nombre" in df.columns:
        n = basic_text(F.col("nombre"))
        out["nombre"] = F.when(n == "", F.lit(config.DEFAULT_NAME)).otherwise(n)
    for c in config.CLEAN_TEXT_COLUMNS:
        if c in df.columns:
            t = title_case(basic_text(F.col(c)))
            out[c] = F.when(t == "", F.lit(config.DEFAULT_CATEGORY)).otherwise(t)
    return df.withColumns(out) if out else df


def _not_convertible(df: DataFrame, c: str, coerced: Column) -> Column:
    """Cleaner flavour of D18: non-blank after trim and not a number."""
    if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
        return F.lit(False)
    raw = F.trim(F.col(c).cast("string"))
    return F.coalesce(raw != "", F.lit(False)) & coerced.isNull()


def _out_of_range(v: Column, lo, hi) -> Column:
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (v < lo)
    if hi is not None:
        cond = cond | (v > hi)
    return v.isNotNull() & cond


@dataclass
class Staged:
    frame: DataFrame
    numeric: list[str]
    ranged: list[str]
    has_id: bool
    has_target: bool
    columns: list[str]
    cache: dict = field(default_factory=dict)


def stage(df: DataFrame, order=ORDER) -> Staged:
    """All per-row cleaning flags and converted values on one frame (no rows dropped yet)."""
    idc, tgt = config.ID_COLUMN, config.TARGET_COLUMN
    columns = [c for c in df.columns if c not in order]
    has_id = idc in df.columns
    x = flag_first(df, idc, order) if has_id else df.withColumns(
        {"_blank": F.lit(False), "_first": F.lit(True)})
    x = x.withColumn("_kept", ~F.col("_blank") & F.col("_first"))
    x = clean_texts(x)
    numeric = [c for c in config.CLEAN_NUMERIC_COLUMNS if c in x.columns]
    # coerce each column once; the non-convertible flag reuses the coerced value
    x = x.withColumns({f"_v_{c}": number(x, c) for c in numeric})
    flags = {f"_nc_{c}": _not_convertible(x, c, F.col(f"_v_{c}")) for c in numeric}
    x = (x.withColumns(flags).withColumns({c: F.col(f"_v_{c}") for c in numeric})
         .drop(*[f"_v_{c}" for c in numeric]))
    ranged = [c for c in config.CLEAN_VALID_RANGES if c in numeric]
    oor = {f"_oor_{c}": _out_of_range(F.col(c), *config.CLEAN_VALID_RANGES[c]) for c in ranged}
    x = x.withColumns(oor).withColumns({c: F.when(~F.col(f"_oor_{c}"), F.col(c)) for c in ranged})
    has_target = tgt in x.columns
    valid = F.coalesce(F.col(tgt).isin(*[float(v) for v in config.TARGET_VALUES]), F.lit(False)) \
        if has_target else F.lit(True)
    x = x.withColumn("_valid_target", valid).withColumn("_survives", F.col("_kept") & F.col("_valid_target"))
    return Staged(x, numeric, ranged, has_id, has_target, columns)


def _median_columns(st: Staged) -> list[str]:
    return [c for c in config.CLEAN_MEDIAN_COLUMNS if c in st.numeric]


def _zero_columns(st: Staged) -> list[str]:
    return [c for c in config.CLEAN_ZERO_COLUMNS if c in st.numeric]


def stage_stats(st: Staged) -> DataFrame:
    """One aggregate row: every report count plus the imputation medians."""
    kept, surv = F.col("_kept"), F.col("_survives")
    aggs = [F.count(F.lit(1)).alias("filas_iniciales"),
            F.count_if(surv).alias("filas_finales"),
            F.count_if(F.col("_blank")).alias("ids_vacios_eliminados"),
            F.count_if(~F.col("_blank") & ~F.col("_first")).alias("duplicados_eliminados"),
            F.count_if(kept & ~F.col("_valid_target")).alias("abandono_invalido_eliminado")]
    for c in st.numeric:
        aggs.append(F.count_if(kept & F.col(f"_nc_{c}")).alias(f"nc_{c}"))
    for c in st.ranged:
        aggs.append(F.count_if(kept & F.col(f"_oor_{c}")).alias(f"oor_{c}"))
    for c in _median_columns(st) + _zero_columns(st):
        aggs.append(F.count_if(surv & F.col(c).isNull()).alias(f"imp_{c}"))
    meds = medians(st)
    for c in _median_columns(st):
        aggs.append(F.lit(meds[c]).cast("double").alias(f"med_{c}"))
    return st.frame.agg(*aggs)


def medians(st: Staged) -> dict[str, float | None]:
    """Exact medians of the median-imputed columns over the surviving rows (NULL if none)."""
    cols = _median_columns(st)
    if not cols:
        return {}
    if "_medians" not in st.cache:
        st.cache["_medians"] = exact_medians(st.frame.filter(F.col("_survives")), {c: F.col(c) for c in cols})
    return st.cache["_medians"]


def _final_values(st: Staged, stats: DataFrame) -> dict[str, Column]:
    med = _median_columns(st)
    meds = medians(st)
    out = {}
    for c in med:
        fill = meds[c] if meds[c] is not None else float(config.CLEAN_FALLBACKS[c])
        out[c] = F.coalesce(F.col(c), F.lit(float(fill)))
    for c in _zero_columns(st):
        out[c] = F.coalesce(F.col(c), F.lit(0.0))
    for c in config.CLEAN_INTEGER_COLUMNS:
        if c in st.numeric:
            out[c] = F.rint(out.get(c, F.col(c))).cast("bigint")  # half-even, like NumPy
    for c in ("monto_mensual", "satisfaccion"):
        if c in st.numeric:
            out[c] = out.get(c, F.col(c)).cast("double")
    return out


def derived_columns(df: DataFrame) -> dict[str, Column]:
    """H9-H12 for the source columns that exist."""
    out = {}
    if "edad" in df.columns:
        out["grupo_edad"] = age_group(F.col("edad"))
    if "antiguedad_meses" in df.columns:
        out["grupo_antiguedad"] = tenure_group(F.col("antiguedad_meses"))
    if "satisfaccion" in df.columns:
        out["nivel_satisfaccion"] = satisfaction_level(F.col("satisfaccion"))
    if "pagos_atrasados" in df.columns:
        out["tiene_morosidad"] = flag_positive(F.col("pagos_atrasados"))
    if "reclamos_ultimos_6_meses" in df.columns:
        out["tiene_reclamos"] = flag_positive(F.col("reclamos_ultimos_6_meses"))
    return out


def clean_rows(st: Staged, stats: DataFrame | None = None) -> DataFrame:
    """V4 output rows: survivors with imputed, typed values and derived columns."""
    stats = stats if stats is not None else stage_stats(st)
    finals = _final_values(st, stats)
    body = st.frame.filter(F.col("_survives")).select(
        *[finals[c].alias(c) if c in finals else F.col(c) for c in st.columns])
    derived = derived_columns(body)
    return body.withColumns(derived) if derived else body


def clean_report(st: Staged, stats: DataFrame | None = None) -> DataFrame:
    """V5: the audit report as long rows (orden, metrica, columna, valor)."""
    stats = stats if stats is not None else stage_stats(st)
    rows: list[Column] = []
    nonempty = F.col("filas_iniciales") > 0

    def row(metric: str, column, value: Column, keep: Column | None = None):
        rows.append(F.struct(F.lit(len(rows)).alias("orden"), F.lit(metric).alias("metrica"),
                             F.lit(column).cast("string").alias("columna"),
                             value.cast("double").alias("valor"),
                             (keep if keep is not None else F.lit(True)).alias("_keep")))

    row("filas_iniciales", None, F.col("filas_iniciales"))
    row("filas_finales", None, F.col("filas_finales"))
    row("filas_eliminadas", None, F.col("filas_iniciales") - F.col("filas_finales"))
    row("duplicados_eliminados", None, F.col("duplicados_eliminados"))
    row("ids_vacios_eliminados", None, F.col("ids_vacios_eliminados"))
    row("abandono_invalido_eliminado", None, F.col("abandono_invalido_eliminado"))
    for c in st.numeric:
        row("valores_no_convertibles", c, F.col(f"nc_{c}"), nonempty)
    for c in st.ranged:
        row("valores_fuera_de_rango", c, F.col(f"oor_{c}"), nonempty)
    for c in _median_columns(st) + _zero_columns(st):
        row("valores_imputados", c, F.col(f"imp_{c}"), nonempty)
    for c in _median_columns(st):
        row("valores_respaldo_usados", c, F.lit(float(config.CLEAN_FALLBACKS[c])),
            nonempty & (F.col(f"imp_{c}") > 0) & F.col(f"med_{c}").isNull())
    present = set(st.columns)
    sources = {"grupo_edad": "edad", "grupo_antiguedad": "antiguedad_meses",
               "nivel_satisfaccion": "satisfaccion", "tiene_morosidad": "pagos_atrasados",
               "tiene_reclamos": "reclamos_ultimos_6_meses"}
    for i, d in enumerate(config.DERIVED_COLUMNS):
        if sources[d] in present:
            row("columnas_derivadas", d, F.lit(i), nonempty)
    return (stats.select(F.explode(F.array(*rows)).alias("r")).filter("r._keep")
            .select("r.orden", "r.metrica", "r.columna", "r.valor"))


def prepare(df: DataFrame, order=ORDER) -> tuple[DataFrame, DataFrame]:
    """V4 + V5: (clean rows, report), both lazy and sharing one staged plan."""
    st = stage(df, order)
    stats = stage_stats(st)
    return clean_rows(st, stats), clean_report(st, stats)
