"""The derived churn tables are stored once per snapshot and reused."""

import os

import pytest

from churnlens.sources import store

SF = "/root/testdata/sf0.001"


def test_materialize_is_idempotent(spark):
    a = store.materialize(spark, SF)
    b = store.materialize(spark, SF)
    assert a == b
    assert store._complete(spark, a)
    derived = store.churn_tables(spark, SF).as_dict()
    for name in store.TABLES:
        assert spark.read.parquet(os.path.join(a, name)).count() == derived[name].count() > 0
    n = spark.read.parquet(os.path.join(SF, "events.parquet")).count() + derived["clientes"].count()
    assert spark.read.parquet(os.path.join(a, store.INTAKE)).count() == n
    t1, t2 = store.stored_tables(spark, SF), store.stored_tables(spark, SF)
    assert t1 is t2  # opened once per session
    assert t1.clientes.count() == spark.read.parquet(os.path.join(SF, "customer.parquet")).count()


def test_snapshot_key_depends_on_inputs(spark):
    assert store.snapshot_key(spark, SF) != store.snapshot_key(spark, "/root/testdata/sf0.01")


def test_nested_input_files_change_the_key(spark, tmp_path):
    for name in store.DRIVER_INPUTS:
        source = spark.read.parquet(os.path.join(SF, f"{name}.parquet"))
        if name == "orders":
            source.withColumn("part", source.o_orderkey % 2).write.partitionBy("part").parquet(
                str(tmp_path / f"{name}.parquet"))
        else:
            os.symlink(os.path.join(SF, f"{name}.parquet"), tmp_path / f"{name}.parquet")
    before = store.snapshot_key(spark, str(tmp_path))
    first = store.materialize(spark, str(tmp_path))
    inner = next(p for p in (tmp_path / "orders.parquet" / "part=1").iterdir() if p.suffix == ".parquet")
    os.utime(inner, (1, 1))
    assert store.snapshot_key(spark, str(tmp_path)) != before
    assert store.materialize(spark, str(tmp_path)) != first


def test_rename_never_moves_into_an_existing_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert not store._rename_new(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["x"]
    assert store._rename_new(spark, str(tmp_path / "a"), str(tmp_path / "c"))


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from churnlens.session import ensure_checkpoint_dir

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session)


def _contracts(spark, rows):
    return spark.createDataFrame(rows, "id_contrato string, id_cliente string, id_servicio long, estado string, "
                                       "monto_mensual double")


def test_principal_reads_its_contracts_a_few_times(spark, tmp_path):
    from churnlens.sources.adapter import mark_principal

    _contracts(spark, [("1-1", "a", 1, "activo", 1.0)]).write.parquet(str(tmp_path / "c"))
    cached = []
    marked = mark_principal(spark.read.parquet(str(tmp_path / "c")), cached)
    leaves = marked._jdf.queryExecution().withCachedData().collectLeaves()
    assert leaves.size() == 3  # active rows, the kept ones, the others; it was 17, as each step read the one before twice
    assert len(cached) == 4
    for df in cached:
        df.unpersist()


def test_principal_ties_repeats_and_nulls(spark):
    from churnlens.sources.adapter import mark_principal

    rows = [("1-1", "a", 1, "activo", 5.0), ("1-2", "a", 2, "activo", 5.0), ("9-9", "a", 9, "inactivo", 9.0),
            ("2-1", "b", 1, "activo", 5.0), ("10-1", "b", 1, "activo", 5.0), ("10-1", "b", 1, "activo", 5.0),
            ("3-1", "c", None, "activo", 7.0), ("3-2", "c", 1, "activo", 6.0), ("4", "d", 1, "activo", 1.0),
            ("5-1", None, 1, "activo", 1.0), ("6-1", "e", 1, None, 1.0), ("7-1", "f", 1, "activo", None)]
    got = mark_principal(_contracts(spark, rows))
    assert got.columns[-1] == "es_principal" and dict(got.dtypes)["es_principal"] == "int"
    marked = [(*r[:-1], r[-1]) for r in got.collect()]
    best = {("1-2", "a"), ("10-1", "b")}  # largest struct, repeats included; one that lacks a value is none
    assert sorted(marked, key=str) == sorted(((*r, int(r[:2] in best)) for r in rows), key=str)


def test_principal_keeps_a_customers_contracts_together(spark):
    from pyspark.sql import functions as F

    from churnlens.sources.adapter import mark_principal

    rows = [(f"{o}-{n}", f"c{o % 5}", n, "activo", float(o)) for o in range(40) for n in range(1, 5)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = mark_principal(_contracts(spark, rows)).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == 160 and len({(r.id_cliente, r.p) for r in got}) == 5  # it was a partition for nearly every contract
    assert sorted(r.id_contrato for r in got if r.es_principal) == ["35-4", "36-4", "37-4", "38-4", "39-4"]


def test_tables_are_stored_without_the_intake(spark, tmp_path):
    for name in store.DRIVER_INPUTS:
        os.symlink(os.path.join(SF, f"{name}.parquet"), tmp_path / f"{name}.parquet")
    tables = store.stored_tables(spark, str(tmp_path))
    folder = store.materialize_tables(spark, str(tmp_path))
    assert tables.clientes.count() > 0 and store._complete(spark, folder)
    assert not os.path.exists(os.path.join(folder, store.INTAKE))  # it was written for every query
    n = spark.read.parquet(os.path.join(SF, "events.parquet")).count() + tables.clientes.count()
    assert store.stored_intake(spark, str(tmp_path)).count() == n
    written = sorted(os.listdir(os.path.join(folder, store.INTAKE)))
    assert store.stored_intake(spark, str(tmp_path)).count() == n and store.stored_tables(spark, str(tmp_path)) is tables
    assert sorted(os.listdir(os.path.join(folder, store.INTAKE))) == written
    assert not [x for x in os.listdir(os.path.dirname(folder)) if ".tmp-" in x]
