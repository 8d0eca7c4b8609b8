"""The merged view against the full derivation: random batches, corrections, moved windows, failures, two writers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from churnlens.plans import behavior, incremental
from churnlens.sources import commits

FACTS = {
    "contratos": "id_contrato string, id_cliente string, id_servicio long, tipo_contrato string, estado string, "
                 "monto_mensual double, es_principal int",
    "reclamos": "id_reclamo string, id_cliente string, fecha date",
    "facturas": "id_factura long, id_cliente string, fecha_emision date",
    "pagos": "id_pago string, id_factura long, estado string",
}
CLIENTES = ("id_cliente string, nombre string, ciudad string, id_sucursal int, antiguedad_meses int, "
            "dias_sin_uso int, satisfaccion int, abandono int, edad int, segmento string")
DAY0 = dt.date(2023, 8, 31)


def _rows(rng, n, tag):
    who = [f"c{i}" for i in range(6)] + [None, "stranger"]

    def day():
        return None if rng.random() < 0.05 else DAY0 + dt.timedelta(days=rng.randint(-260, 200))

    return {
        "contratos": [(f"{tag}k{i}", rng.choice(who), rng.choice([1, 2, 3, 9]), rng.choice(["A", "B", None]),
                       rng.choice(["activo", "activo", "inactivo"]), rng.choice([None, 10.25, 99.999999, 7.0]),
                       rng.choice([0, 1])) for i in range(n)],
        "reclamos": [(f"{tag}r{i}", rng.choice(who), day()) for i in range(n)],
        "facturas": [(rng.choice([1000 + rng.randint(0, 40), None]), rng.choice(who), day()) for i in range(n)],
        "pagos": [(f"{tag}p{i}", rng.choice([1000 + rng.randint(0, 40), None]),
                   rng.choice(["atrasado", "a_tiempo"])) for i in range(n)],
    }


def _frames(spark, rows):
    return {n: spark.createDataFrame(rows[n], s) for n, s in FACTS.items()}


def _signed(spark, add, take):
    return incremental.FactBatch(**{
        n: spark.createDataFrame([(*r, 1) for r in add[n]] + [(*r, -1) for r in take[n]], s + ", signo int")
        for n, s in FACTS.items()})


def _dims(spark):
    people = [(f"c{i}", f"N{i}", "X", i % 3, i, i, 3, i % 2, 30 + i, None) for i in range(7)]
    return (spark.createDataFrame(people, CLIENTES),
            spark.createDataFrame([(0, "Norte"), (1, "Sur")], "id_sucursal int, region string"),
            spark.createDataFrame([(1, "uno"), (2, "dos"), (3, "tres")], "id_servicio long, nombre string"))


def _all(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_equal_full_derivation(spark, tmp_path):
    rng, root = random.Random(7), str(tmp_path / "state")
    people, places, services = _dims(spark)
    known = {n: [] for n in FACTS}
    for step, ref in enumerate([DAY0, DAY0 + dt.timedelta(days=45), DAY0 - dt.timedelta(days=100)]):
        add = _rows(rng, 25, f"b{step}")
        take = {n: rng.sample(known[n], min(5, len(known[n]))) for n in FACTS}  # corrections of earlier facts
        for n in FACTS:
            for r in take[n]:
                known[n].remove(r)
            known[n] += add[n]
        if step == 2:  # a service renamed and one that contracts named before it was known
            services = spark.createDataFrame([(1, "uno"), (2, "zwei"), (3, "tres"), (9, "nueve")], services.schema)
        incremental.apply_batch(spark, root, _signed(spark, add, take), services, ref)
        f = _frames(spark, known)
        want = behavior.customer_behavior(people, places, services, f["contratos"], f["reclamos"], f["facturas"],
                                          f["pagos"], ref)
        assert _all(incremental.current_view(spark, root, people, places)) == _all(want)
    before = _all(incremental.current_view(spark, root, people, places))
    content = incremental.compact(spark, root)
    assert [len(content[s]) for s in incremental.STATES] == [1, 1, 1, 1]
    # an empty batch after the compaction only moves the window
    empty = incremental.FactBatch(**_frames(spark, {n: [] for n in FACTS}))
    incremental.apply_batch(spark, root, empty, services, DAY0 - dt.timedelta(days=100))
    assert _all(incremental.current_view(spark, root, people, places)) == before


def test_only_days_at_the_edges_are_read(spark, tmp_path):
    root, (people, places, services) = str(tmp_path / "state"), _dims(spark)
    facts = {n: [] for n in FACTS}
    facts["reclamos"] = [(f"r{i}", "c1", DAY0 - dt.timedelta(days=i)) for i in range(400)]
    incremental.apply_batch(spark, root, incremental.FactBatch(**_frames(spark, facts)), services, DAY0)
    _, content = commits.latest(spark, root)
    moved = incremental.moved_days(spark, root, content, ("2023-03-10", "2023-09-10"))
    assert moved.count() == len([d for d in range(400) if dt.date(2023, 2, 28) <= DAY0 - dt.timedelta(days=d)
                                 < dt.date(2023, 3, 10)])
    plan = moved._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "dia" in pushed and "2023-03-10" in pushed


def test_failed_batch_changes_nothing(spark, tmp_path):
    root, (people, places, services) = str(tmp_path / "state"), _dims(spark)
    rows = _rows(random.Random(1), 10, "a")
    incremental.apply_batch(spark, root, incremental.FactBatch(**_frames(spark, rows)), services, DAY0)
    before = _all(incremental.current_view(spark, root, people, places))
    bad = _frames(spark, rows)
    bad["contratos"] = bad["contratos"].withColumn("monto_mensual", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        incremental.apply_batch(spark, root, incremental.FactBatch(**bad), services, DAY0)
    assert _all(incremental.current_view(spark, root, people, places)) == before
    with pytest.raises(FileNotFoundError):
        incremental.current_view(spark, str(tmp_path / "none"), people, places)


def test_two_writers_and_vacuum(spark, tmp_path):
    root = str(tmp_path / "log")
    seen = []

    def slow(content):  # another writer commits while this one works, once
        seen.append(len(content.get("x", [])))
        if len(seen) == 1:
            commits.update(spark, root, lambda c: {"x": [*c.get("x", []), "theirs"]})
        return {"x": [*content.get("x", []), "ours"]}

    assert commits.update(spark, root, slow) == {"x": ["theirs", "ours"]} and seen == [0, 1]
    assert not commits.commit(spark, root, 2, {"x": []})
    for name in ("theirs", "ours", "new", "stray"):
        os.makedirs(os.path.join(root, name))
    commits.update(spark, root, lambda c: {"x": ["new"]})
    assert commits.vacuum(spark, root, lambda c: c["x"], keep=2) == []  # an open reader's folders stay
    assert commits.vacuum(spark, root, lambda c: c["x"], keep=1) == ["ours", "theirs"]
    assert os.path.isdir(os.path.join(root, "stray")) and commits.latest(spark, root) == (3, {"x": ["new"]})


def test_one_folder_of_a_state_is_not_summed_again(spark, tmp_path):
    rows = [("a", 1), ("b", -2), (None, 3)]
    for folder in ("one", "two"):
        spark.createDataFrame(rows, "id_factura string, n long").write.parquet(str(tmp_path / folder))

    def read(*folders):
        return incremental.read_state(spark, str(tmp_path), "atrasados", {"atrasados": list(folders)})

    assert sorted(map(tuple, read("one").collect()), key=str) == sorted(rows, key=str)
    assert "Aggregate" not in read("one")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, read("one", "two").collect()), key=str) == sorted([(k, 2 * n) for k, n in rows], key=str)
