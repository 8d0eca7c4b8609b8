"""Display formats (thousands '.', two decimals, '$', comma decimals)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column, digits: int) -> Column:
    """NumPy-style rounding: half-even on the scaled binary value (``rint(x * 10^d) / 10^d``)."""
    scale = float(10 ** digits)
    return F.rint(c.cast("double") * scale) / scale


def _split(x: Column) -> tuple[Column, Column]:
    """Veltkamp split: x = hi + lo exactly, each half with at most 26 significant bits."""
    p = x * F.lit(134217729.0)  # 2^27 + 1
    hi = p - (p - x)
    return hi, x - hi


def fixed2_text(c: Column) -> Column:
    """Python's ``f"{x:.2f}"``: the *exact* binary value rounded half-even to 2 decimals.

    Spark's ``format_string``/``bround`` round the shortest decimal text
    (12.345 -> 12.34 / 12.35 depending on the function), Python rounds the
    exact double (12.345 is stored slightly above, so 12.35; 0.125 is an exact
    tie, so 12).  The midpoint test ``x*200 - (2k+1)`` is evaluated exactly:
    both split halves times 200 are exact products, the first subtraction is
    exact (Sterbenz) and the sign of the final sum is exact.
    """
    x = c.cast("double")
    k = F.floor(x * F.lit(100.0))
    d = k * 2 + 1
    hi, lo = _split(x)
    s = F.signum((hi * F.lit(200.0) - d.cast("double")) + lo * F.lit(200.0))
    up = (s > 0) | ((s == 0) & (F.pmod(k, F.lit(2)) == 1))
    n = F.when(up, k + 1).otherwise(k)
    a = F.abs(n)
    neg = (n < 0) | ((n == 0) & (x < 0))
    text = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), (a / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad(F.pmod(a, F.lit(100)).cast("string"), 2, "0"))
    return F.when(x.isNotNull() & ~F.isnan(x), text)


def fmt_integer(c: Column) -> Column:
    """1234 -> '1.234' (truncated to integer)."""
    return F.translate(F.format_number(c.cast("long"), 0), ",", ".")


def fmt_pct(c: Column) -> Column:
    """12.345 -> '12.35%'."""
    return F.concat(fixed2_text(c), F.lit("%"))


def fmt_mean(c: Column) -> Column:
    return fixed2_text(c)


def fmt_amount(c: Column) -> Column:
    """12345.4 -> '$12.345'."""
    return F.concat(F.lit("$"), F.translate(F.format_number(F.bround(c.cast("double"), 0), 0), ",", "."))


def fmt_prediction_pct(c: Column) -> Column:
    """50.0 -> '50,00 %'."""
    return F.translate(F.concat(fixed2_text(c), F.lit(" %")), ".", ",")
