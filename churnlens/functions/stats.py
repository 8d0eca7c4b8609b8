"""H13 safe percentage and ratio, correlation direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import config


def safe_pct(num: Column, den: Column) -> Column:
    """num / den * 100; NULL or zero denominator -> 0.0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")) * 100, F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; NULL or zero denominator -> 0.0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def direction_of(r: Column, threshold: float = config.CORRELATION_THRESHOLD) -> Column:
    return (F.when(r > threshold, config.DIRECTION_POSITIVE)
            .when(r < -threshold, config.DIRECTION_NEGATIVE)
            .otherwise(config.DIRECTION_NONE))
