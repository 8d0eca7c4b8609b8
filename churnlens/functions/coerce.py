"""H1: lenient numeric coercion (bad text -> NULL), NaN -> NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import config


#: ASCII white space, which a numeric text parser skips on both sides.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def _decimal_exponent(t: Column) -> Column:
    """The power of ten a pandas-style text parser scales its digits by.

    Leading integer zeros are skipped, at most 17 significant digits are
    kept (extra integer digits raise the exponent, extra fraction digits are
    dropped) and every kept fraction digit lowers it.
    """
    exp = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("double"), F.lit(0.0))
    li = F.length(F.regexp_extract(t, r"^[+-]?0*([0-9]*)", 1))
    lf = F.length(F.regexp_extract(t, r"\.([0-9]*)", 1))
    kept_frac = F.least(lf, F.greatest(F.lit(17) - li, F.lit(0)))
    return exp - kept_frac + F.greatest(li - F.lit(17), F.lit(0))


def _string_to_number(c: Column) -> Column:
    # Spark's try_cast also accepts suffixes such as '12d' / '1f'; the guard
    # regex keeps exactly plain decimal / scientific notation.  Like the
    # reference's parser, a decimal exponent beyond 308 or an overflow to
    # infinity is a missing value (underflow gives 0).
    t = F.trim(c, F.lit(WHITE_SPACE))
    v = t.try_cast("double")
    # only text with an exponent, or longer than any in-range plain number, can leave the range
    may_overflow = t.contains("e") | t.contains("E") | (F.length(t) > config.MAX_DECIMAL_EXPONENT)
    in_range = F.when(may_overflow, (_decimal_exponent(t) <= config.MAX_DECIMAL_EXPONENT)
                      & (F.abs(v) != F.lit(float("inf")))).otherwise(F.lit(True))
    return F.when(t.rlike(config.NUMBER_PATTERN) & in_range, v)


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a nullable double (coerced, NaN -> NULL)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        v = _string_to_number(c)
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        v = c.cast("double")
    else:
        v = _string_to_number(c.cast("string"))
    return F.when(~F.isnan(v), v)


def number_or_null(df: DataFrame, name: str) -> Column:
    """``number`` when the column exists, NULL double otherwise (plan-time test)."""
    if name in df.columns:
        return number(df, name)
    return F.lit(None).cast("double")


def is_blank(c: Column) -> Column:
    """NULL or empty after trimming."""
    return c.isNull() | (F.trim(c.cast("string"), F.lit(WHITE_SPACE)) == "")


def na_tokens_to_null(df: DataFrame) -> DataFrame:
    """Treat the usual missing-value tokens of a CSV reader as NULL (string columns)."""
    tokens = [t for t in config.NA_TOKENS if t != ""]
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = F.col(f.name)
            exprs[f.name] = F.when(~c.isin(tokens) & (c != ""), c)
    return df.withColumns(exprs) if exprs else df


def coerce_numeric_columns(df: DataFrame, columns=config.NUMERIC_COLUMNS) -> DataFrame:
    """A5: the numeric contract columns as nullable doubles; bad text -> NULL, no row dropped."""
    present = {c: number(df, c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df
