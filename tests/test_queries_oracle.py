"""Every registered query runs on the driver tables (sf0.001) and equals its DuckDB oracle."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from churnlens.plans.queries import QUERIES as _CORE  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()
#: Queries without SQL, and rows they return per row of the input table named (or a fixed number).
ROWS = {"tree_scores": "customer", "logistic_scores": "customer", "kmeans_segments": "customer",
        "kmeans_cluster_summary": 3}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["tipo_contrato", "total_clientes", "clientes_abandonaron", "tasa_abandono"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(_CORE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        n = ROWS[name]
        assert len(got) == (n if isinstance(n, int) else con.execute(f"SELECT count(*) FROM {n}").fetchone()[0])
        return
    want = con.execute(SQL[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert gr == wr
