"""Search, filters, lookup, projections, sorts, options.

All return lazy DataFrames; none collects rows.  Filters promise no row
order (Spark has none); ``sort_customers`` / ``order_by_id`` give one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import number
from churnlens.functions.text import label_of_target, state_label


def _none(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def search(df: DataFrame, term: str | None, id_col: str = config.ID_COLUMN) -> DataFrame:
    """B1: case-insensitive literal substring over id OR name; blank term -> all rows."""
    t = str(term or "").strip()
    if not t:
        return df
    cols = [c for c in (id_col, "nombre") if c in df.columns]
    if not cols:
        return _none(df)
    needle = F.lit(t.upper())
    return df.filter(reduce(lambda a, b: a | b,
                            [F.coalesce(F.upper(F.col(c).cast("string")).contains(needle), F.lit(False))
                             for c in cols]))


def filter_by_options(df: DataFrame, column: str, options) -> DataFrame:
    """Trimmed, case-sensitive IN-list; empty list or absent column -> no filter."""
    if not options or column not in df.columns:
        return df
    clean = sorted({str(o).strip() for o in options if str(o).strip()})
    if not clean:
        return df
    return df.filter(F.trim(F.col(column).cast("string")).isin(clean))


def filter_target(df: DataFrame, value, target: str = config.TARGET_COLUMN) -> DataFrame:
    if value is None or target not in df.columns:
        return df
    return df.filter(number(df, target) == float(value))


def analysis_filter(df: DataFrame, cities=None, contract_types=None, plans=None, target=None) -> DataFrame:
    """Category IN-lists AND target equality."""
    out = filter_by_options(df, "ciudad", cities)
    out = filter_by_options(out, "tipo_contrato", contract_types)
    out = filter_by_options(out, "plan", plans)
    return filter_target(out, target)


def filter_customers(df: DataFrame, term: str = "", cities=None, contract_types=None, plans=None,
                     target=None) -> DataFrame:
    """B2: search AND analysis filter."""
    return analysis_filter(search(df, term), cities, contract_types, plans, target)


def lookup(df: DataFrame, customer_id: str | None, id_col: str = config.ID_COLUMN) -> DataFrame:
    """First row whose trimmed id equals the trimmed argument (0 or 1 row)."""
    key = str(customer_id or "").strip()
    if not key or id_col not in df.columns:
        return _none(df)
    return (df.filter(F.trim(F.col(id_col).cast("string")) == key)
            .orderBy(F.col(id_col).asc_nulls_last()).limit(1))


def display_table(df: DataFrame, columns=config.TABLE_COLUMNS, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Existing columns in the given order; target shown as its label."""
    keep = [c for c in columns if c in df.columns]
    exprs = [label_of_target(F.col(c), number(df, c)).alias(c) if c == target else F.col(c) for c in keep]
    return df.select(*exprs)


def profile_card(df: DataFrame, id_col: str = config.ID_COLUMN) -> DataFrame:
    """Wide -> long (id, orden, campo, valor) with NULL values dropped."""
    items = []
    for pos, (label, col) in enumerate(config.CARD_FIELDS):
        if col == config.TARGET_COLUMN:
            value = label_of_target(F.col(col), number(df, col)) if col in df.columns else F.lit("None")
        elif col in df.columns:
            value = F.col(col).cast("string")
        else:
            value = F.lit(None).cast("string")
        items.append(F.struct(F.lit(pos).alias("orden"), F.lit(label).alias("campo"), value.alias("valor")))
    return (df.select(F.col(id_col).alias(id_col), F.explode(F.array(*items)).alias("f"))
            .select(id_col, "f.orden", "f.campo", "f.valor")
            .filter(F.col("valor").isNotNull()))


def valid_target(df: DataFrame, target: str = config.TARGET_COLUMN) -> DataFrame:
    """Keep rows whose (coerced) target is 0 or 1."""
    return df.filter(number(df, target).isin(0.0, 1.0))


def boxplot_input(df: DataFrame, variable: str, target: str = config.TARGET_COLUMN) -> DataFrame:
    """(estado_abandono, variable) for rows with both values present and target 0/1."""
    if variable not in config.BOXPLOT_VARIABLES:
        raise ValueError(f"no box plot is offered for {variable}")
    if variable not in df.columns:
        raise ValueError(f"the input has no column {variable}")
    if target not in df.columns:
        raise ValueError(f"the input has no column {target}")
    v, t = number(df, variable), number(df, target)
    return (df.select(v.alias(variable), t.alias("_t"))
            .filter(F.col(variable).isNotNull() & F.col("_t").isin(0.0, 1.0))
            .select(state_label(F.col("_t")).alias("estado_abandono"), variable))


def sort_customers(df: DataFrame, column: str, ascending: bool = True,
                   id_col: str = config.ID_COLUMN) -> DataFrame:
    """whitelisted, stable (id tiebreak), NULLs last in both directions."""
    if column not in config.SORTABLE_COLUMNS or column not in df.columns:
        return df
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    ties = [F.col(id_col).asc()] if id_col in df.columns and id_col != column else []
    return df.orderBy(key, *ties)


def order_by_id(df: DataFrame, id_col: str = config.ID_COLUMN) -> DataFrame:
    """binary-collation order by id."""
    return df.orderBy(F.col(id_col).asc())


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Unique trimmed non-empty values in case-folded order (column ``valor``).

    Values equal after case folding are ordered by their binary value (the
    reference keeps their first appearance; tracking that would need a
    sort-based ``min(string)`` aggregate over every row).
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "valor string")
    v = F.trim(F.col(column).cast("string"))
    return (df.select(v.alias("valor")).filter(F.col("valor").isNotNull() & (F.col("valor") != ""))
            .distinct().orderBy(F.lower("valor"), "valor"))


def count_results(df: DataFrame | None) -> int:
    """Row count (None -> 0)."""
    return 0 if df is None else df.count()


def preview(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """The first ``n`` rows in an explicit order (input order columns by default)."""
    keys = order_by or [c for c in ("_src", "_pos") if c in df.columns] or [config.ID_COLUMN]
    return df.orderBy(*keys).limit(n)


def display_labels(df: DataFrame, labels=None) -> DataFrame:
    """Rename known columns to their display labels; unknown columns unchanged."""
    mapping = dict(config.COLUMN_LABELS)
    mapping.update(labels or {})
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df
