"""Bins, flags and risk level as CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import config


def _chain(c: Column, bins, last: str) -> Column:
    expr = None
    for upper, label in bins:
        expr = F.when(c <= upper, label) if expr is None else expr.when(c <= upper, label)
    return expr.otherwise(last)


def age_group(c: Column) -> Column:
    return _chain(c, config.AGE_BINS, config.AGE_BIN_LAST)


def tenure_group(c: Column) -> Column:
    return _chain(c, config.TENURE_BINS, config.TENURE_BIN_LAST)


def satisfaction_level(c: Column) -> Column:
    # <=2 low, exactly 3 medium, anything else (incl. an imputed 2.5) high
    return (F.when(c <= 2, config.SATISFACTION_LOW)
            .when(c == 3, config.SATISFACTION_MID)
            .otherwise(config.SATISFACTION_HIGH))


def flag_positive(c: Column) -> Column:
    return (c > 0).cast("bigint")


def risk_level(p: Column, low_below: float = config.RISK_LOW_BELOW,
               high_from: float = config.RISK_HIGH_FROM) -> Column:
    """Bucket on the *unrounded* probability."""
    return (F.when(p < low_below, config.RISK_LEVELS[0])
            .when(p < high_from, config.RISK_LEVELS[1])
            .otherwise(config.RISK_LEVELS[2]))
