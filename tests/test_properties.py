"""Property tests: column-expression builders agree with the Python/pandas semantics they re-express."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlens.functions.coerce import number
from churnlens.functions.formats import fixed2_text, np_round
from churnlens.functions.text import basic_text, title_case

SETTINGS = settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.text(alphabet="0123456789+-.eE _ab", max_size=8), min_size=1, max_size=300))
def test_number_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(number(df, "x")).collect()]
    want = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce").tolist()
    for v, g, w in zip(values, got, want):
        w = None if w is None or (isinstance(w, float) and math.isnan(w)) else float(w)
        assert g == w, v


@SETTINGS
@given(st.lists(st.text(alphabet="abcxyzÁéñüçAZ019 '-.,\t", max_size=12), min_size=1, max_size=300))
def test_text_normalisation_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = df.select(basic_text(F.col("x")).alias("b"), title_case(basic_text(F.col("x"))).alias("t")).collect()
    for v, r in zip(values, got):
        b = " ".join(v.split()) if v.strip() else ""
        assert r["b"] == b, v
        assert r["t"] == b.title(), v


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=300))
def test_rounding_matches_python_and_numpy(spark, values):
    import numpy as np
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(fixed2_text(F.col("x")).alias("t"), np_round(F.col("x"), 4).alias("r")).collect()
    for v, r in zip(values, got):
        assert r["t"] == f"{v:.2f}", v
        assert r["r"] == float(np.round(v, 4)), v
