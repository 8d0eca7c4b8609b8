"""B1 by an index: the same rows as the plain search, read through postings and pruned blocks."""

import random

import pytest

from churnlens.operators import explore, text_index

SCHEMA = "id_cliente string, nombre string, ciudad string"
TERMS = [None, "", "  ", "a", "ñu", "ana", " ANA ", "rio", "K-0", "k-017", "100%", "a_b", ".*", "straße", "STRASSE", "x\ny",
         "𝔸bc", "bc𝔸", "nobody", "zzz", "ana rio", "é r"]


def generated(n: int = 400) -> list[tuple]:
    rnd = random.Random(6)
    words = ["Ana", "rio", "Ñuñoa", "100%", "a_b", "Straße", "x\ny", "𝔸bc𝔸", "é", "Bo", "ANAnas", ".*.*"]
    rows = [(f"K-{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(4))), "c") for i in range(n)]
    return [*rows, (None, "Ana sin id", "c"), ("K-900", None, "d"), (None, None, None), ("", "", ""), rows[17], rows[17]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    df = spark.createDataFrame(generated(), SCHEMA).cache()
    text_index.build_index(df.repartition(3), path, block_rows=40)
    return df, path


@pytest.mark.parametrize("share", [0.2, 1.0])
def test_rows_equal_the_plain_search(spark, index, monkeypatch, share):
    df, path = index
    monkeypatch.setattr(text_index, "SCAN_SHARE", share)
    for term in TERMS:
        got = text_index.search_index(spark, path, term)
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, explore.search(df, term).collect())), term


def test_only_blocks_of_hits_are_read(spark, index):
    _, path = index
    got = text_index.search_index(spark, path, "k-017")
    rows = got.collect()
    assert len(rows) == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "In(gram" in plan and "BroadcastHashJoin" in plan
    blocks = {r["_bloque"] for r in text_index._rows(spark, path).where("id_cliente = 'K-017'").collect()}
    every = text_index._rows(spark, path).select("_bloque").distinct().count()
    assert len(blocks) == 1 and every >= 8


def test_missing_grams_and_large_hits(spark, index, monkeypatch):
    df, path = index
    assert text_index.search_index(spark, path, "qqqq").count() == 0
    monkeypatch.setattr(text_index, "BROADCAST_HITS", 0)
    assert text_index.search_index(spark, path, "straße").count() == explore.search(df, "straße").count() > 0


def test_empty_table_other_columns_and_clashes(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    text_index.build_index(none, str(tmp_path / "none"))
    assert text_index.search_index(spark, str(tmp_path / "none"), "ana").count() == 0
    assert text_index.search_index(spark, str(tmp_path / "none"), "").columns == none.columns
    other = spark.createDataFrame([(1, "ana")], "x int, y string")
    text_index.build_index(other, str(tmp_path / "other"))
    assert text_index.search_index(spark, str(tmp_path / "other"), "ana").count() == 0
    with pytest.raises(ValueError, match="_fila"):
        text_index.build_index(other.withColumnRenamed("x", "_fila"), str(tmp_path / "clash"))


def test_long_names(spark, tmp_path):
    long = "abcdefg" * 20_000
    df = spark.createDataFrame([("1", long, ""), ("2", "abc", "")], SCHEMA)
    text_index.build_index(df, str(tmp_path / "long"))
    assert [r.id_cliente for r in text_index.search_index(spark, str(tmp_path / "long"), long[3:90_000]).collect()] == ["1"]
