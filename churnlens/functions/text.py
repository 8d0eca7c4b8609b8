"""Text normalisation, title case, target labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import config


def basic_text(c: Column) -> Column:
    """NULL -> '', trim, collapse every run of (unicode) whitespace to one blank."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """Word-initial upper case where a 'word' is a run of letters.

    ``initcap`` only splits on blanks ("O'higgins"); this splits on every
    non-letter, giving "O'Higgins San-Juan 3Er" like Python's ``str.title``.
    """
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cap = F.transform(parts, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30)))
    return F.when(c.isNotNull(), F.array_join(cap, ""))


def label_of_target(raw: Column, numeric: Column) -> Column:
    """0 -> 'Permanece', 1 -> 'Abandonó', anything else -> its own text."""
    as_int = numeric.cast("int")
    out = F.coalesce(raw.cast("string"), F.lit("None"))
    for value, label in config.TARGET_LABELS.items():
        out = F.when(numeric.isNotNull() & (as_int == value), F.lit(label)).otherwise(out)
    return out


def state_label(target: Column) -> Column:
    """Label for a target already restricted to 0/1."""
    expr = None
    for value, label in config.TARGET_LABELS.items():
        expr = (F.when(target == value, F.lit(label)) if expr is None
                else expr.when(target == value, F.lit(label)))
    return expr


def selection_label(id_col: Column, name_col: Column) -> Column:
    """B8: 'id - nombre'."""
    return F.concat_ws(" - ", F.coalesce(id_col.cast("string"), F.lit("")),
                       F.coalesce(name_col.cast("string"), F.lit("")))


def id_from_label(label: Column) -> Column:
    """Text before the first ' - '."""
    return F.split(label, " - ", 2).getItem(0)
