"""Bounded exact quantiles equal the interpolated quantile of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [50, 1000, 100000])
def test_matches_numpy(spark, accuracy):
    rnd = random.Random(7)
    vals = [rnd.gauss(0, 1000) for _ in range(3000)] + [5.0] * 700 + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    got = exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], accuracy)["x"]
    ref = np.quantile(np.array([v for v in vals if v is not None]), [0.25, 0.5, 0.75])
    assert got == pytest.approx(list(ref), rel=1e-12, abs=1e-9)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5])["x"] == [6.0]
    assert exact_quantiles(df.limit(0), {"x": F.col("x")}, [0.5])["x"] == [None]
