"""C6-C9 on a literal relational set (F9) and the A7/A10/A11 sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from churnlens.operators import integrity
from churnlens.plans.behavior import customer_behavior, require_view_columns
from churnlens.sources import customers, sinks


@pytest.fixture()
def rel(spark):
    d = dt.date
    t = {
        "sucursales": spark.createDataFrame([(1, "Centro", "Santiago", "RM")],
                                            "id_sucursal int, nombre string, ciudad_sede string, region string"),
        "servicios": spark.createDataFrame([(10, "FIB", "Fibra", "internet", 20000.0),
                                            (11, "TV", "TV", "tv", 10000.0)],
                                           "id_servicio long, codigo string, nombre string, tipo string, "
                                           "precio_mensual double"),
        "clientes": spark.createDataFrame(
            [(f"C{i}", f"N{i}", "Santiago", 1 if i != 6 else 9, "Hogar", 12, 3, 5, 0) for i in range(1, 7)],
            "id_cliente string, nombre string, ciudad string, id_sucursal int, segmento string, "
            "antiguedad_meses int, satisfaccion int, dias_sin_uso int, abandono int"),
        # C1 none; C2 two active (one principal); C3 inactive only; C4 principal twice; C5 one; C6 orphan branch
        "contratos": spark.createDataFrame(
            [("k1", "C2", 10, "Mensual", "activo", 20000.0, 1), ("k2", "C2", 11, "Mensual", "activo", 10000.0, 0),
             ("k3", "C3", 10, "Anual", "inactivo", 5000.0, 0), ("k4", "C4", 10, "Anual", "activo", 1.0, 1),
             ("k5", "C4", 11, "Anual", "activo", 2.0, 1), ("k6", "C5", 99, "Anual", "activo", 3.0, 1),
             ("k7", "C6", 10, "Mensual", "activo", 4.0, 1)],
            "id_contrato string, id_cliente string, id_servicio long, tipo_contrato string, estado string, "
            "monto_mensual double, es_principal int"),
        "facturas": spark.createDataFrame(
            [(1, "C2", d(2026, 1, 1)), (2, "C2", d(2026, 6, 28)), (3, "C2", d(2025, 12, 27)),
             (4, "C5", d(2026, 3, 1))], "id_factura long, id_cliente string, fecha_emision date"),
        "pagos": spark.createDataFrame(
            [("p1", 1, "atrasado"), ("p1b", 1, "atrasado"), ("p2", 2, "a_tiempo"), ("p3", 3, "atrasado"),
             ("p4", 4, "atrasado"), ("p5", 77, "atrasado")], "id_pago string, id_factura long, estado string"),
        "reclamos": spark.createDataFrame(
            [("r1", "C2", d(2025, 12, 28)), ("r2", "C2", d(2026, 6, 28)), ("r3", "C2", d(2025, 12, 27)),
             ("r4", "C2", d(2026, 6, 29)), ("r5", "CX", d(2026, 1, 1))],
            "id_reclamo string, id_cliente string, fecha date"),
    }
    return t


def test_view_windows_and_defaults(rel):
    v = customer_behavior(rel["clientes"], rel["sucursales"], rel["servicios"], rel["contratos"], rel["reclamos"],
                          rel["facturas"], rel["pagos"], dt.date(2026, 6, 28))
    rows = {r["id_cliente"]: r for r in v.collect()}
    c2 = rows["C2"]
    assert c2["reclamos_ultimos_6_meses"] == 2  # both window ends included, one day outside each excluded
    assert c2["pagos_atrasados"] == 2  # invoice in window, payment fan-out counted
    assert (c2["monto_mensual"], c2["cantidad_servicios"], c2["plan"], c2["tipo_contrato"]) == (30000.0, 2, "Fibra",
                                                                                                "Mensual")
    c1 = rows["C1"]
    assert (c1["monto_mensual"], c1["cantidad_servicios"], c1["plan"]) == (0.0, 0, None)
    assert rows["C5"]["cantidad_servicios"] == 0  # active contract without service is dropped
    assert rows["C6"]["region"] is None  # branchless customer kept
    assert require_view_columns(v) is v
    with pytest.raises(RuntimeError, match="nombre"):
        require_view_columns(v.drop("nombre"))


def test_orphans_and_rules(rel):
    fk = {(r["tabla"], r["columna"]): r["huerfanos"] for r in integrity.fk_orphans(rel).collect()}
    assert fk[("clientes", "id_sucursal")] == 1
    assert fk[("contratos", "id_servicio")] == 1
    assert fk[("pagos", "id_factura")] == 1
    assert fk[("reclamos", "id_cliente")] == 1
    ck = {(r["tabla"], r["regla"]): r["violaciones"] for r in integrity.check_violations(rel).collect()}
    assert ck[("contratos", "un_principal_activo")] == 1
    assert ck[("clientes", "pk_unico")] == 0
    assert [r["id_cliente"] for r in integrity.duplicate_principals(rel["contratos"]).collect()]  # a real duplicate
    rule = integrity.principal_rule(rel["clientes"], rel["contratos"]).first()
    assert (rule["sin_principal"], rule["con_mas_de_uno"], rule["valido"]) == (2, 1, False)
    assert rule["mensaje"].startswith("Integridad de contratos: 2 cliente(s)")
    with pytest.raises(ValueError):
        integrity.assert_principal_rule(rel["clientes"], rel["contratos"])


def _pred(spark, ids, p=0.5):
    return spark.createDataFrame([(i, p, "medio") for i in ids],
                                 "id_cliente string, probabilidad_churn double, nivel_riesgo string")


def test_prediction_history_append_and_replace(spark, tmp_path):
    root = str(tmp_path / "hist")
    assert sinks.write_predictions(_pred(spark, ["a", "b"]), root, "arbol", "v1") == 2
    assert sinks.write_predictions(_pred(spark, ["a", "b"]), root, "arbol", "v2") == 2
    assert sinks.write_predictions(_pred(spark, ["a", "b"]), root, "arbol", "v1") == 2  # same second: own run
    h = sinks.read_history(spark, root)
    assert h.count() == 6  # appended by default
    assert h.select("corrida").distinct().count() == 3
    assert sinks.write_predictions(_pred(spark, ["c"]), root, "arbol", "v1", replace=True) == 1
    h = sinks.read_history(spark, root)
    assert h.filter("version_modelo = 'v1'").count() == 1  # only this version replaced
    assert h.filter("version_modelo = 'v2'").count() == 2
    assert sinks.write_predictions(_pred(spark, []), root, "arbol", "v1", replace=True) == 0
    h = sinks.read_history(spark, root)
    assert h.filter("version_modelo = 'v1'").count() == 0  # replaced by nothing
    assert h.filter("version_modelo = 'v2'").count() == 2


def test_history_refuses_bad_rows(spark, tmp_path):
    root = str(tmp_path / "hist")
    known = spark.createDataFrame([("a",)], "id_cliente string")
    with pytest.raises(ValueError, match="unknown customers"):
        sinks.write_predictions(_pred(spark, ["a", "NOBODY"]), root, clientes=known)
    with pytest.raises(ValueError, match="check_probabilidad_0_1"):
        sinks.write_predictions(_pred(spark, ["a"], 7.5), root, clientes=known)
    bad = _pred(spark, ["a"]).withColumn("nivel_riesgo", F.lit("zzz"))
    with pytest.raises(ValueError, match="check_nivel_valido"):
        sinks.write_predictions(bad, root, clientes=known)
    with pytest.raises(ValueError, match="not_null_id_cliente"):
        sinks.write_predictions(_pred(spark, [None]), root)
    assert not sinks.path_exists(spark, root)
    assert sinks.write_predictions(_pred(spark, ["a"]), root, clientes=known) == 1


def test_operational_reload(spark, tmp_path, rel):
    root, hist = str(tmp_path / "db"), str(tmp_path / "hist")
    ok = {k: rel[k] for k in ("sucursales", "servicios", "clientes")}
    ok["clientes"] = ok["clientes"].withColumn("id_sucursal", F.lit(None).cast("int"))
    out = sinks.publish_operational(ok, root, hist, check_principal=False)
    assert out["clientes"] == 6
    with pytest.raises(RuntimeError, match="reset=True"):
        sinks.publish_operational(ok, root, hist, check_principal=False)
    sinks.write_predictions(_pred(spark, ["C1", "C6"]), hist)
    fewer = dict(ok, clientes=ok["clientes"].filter("id_cliente != 'C6'"))
    with pytest.raises(RuntimeError, match="predicciones"):
        sinks.publish_operational(fewer, root, hist, reset=True, check_principal=False)
    assert sinks.read_live(spark, root, "clientes").count() == 6  # live data untouched
    sinks.publish_operational(fewer, root, hist, reset=True, reset_predictions=True, check_principal=False)
    assert sinks.read_live(spark, root, "clientes").count() == 5
    with pytest.raises(ValueError, match="Integridad de contratos"):
        sinks.publish_operational(dict(ok, contratos=rel["contratos"]), root, None, reset=True, check_integrity=False)
    with pytest.raises(ValueError, match="contratos.id_servicio"):  # a contract of an unknown service
        sinks.publish_operational(dict(ok, contratos=rel["contratos"]), root, None, reset=True, check_principal=False)
    strangers = rel["contratos"].withColumn("id_cliente", F.lit("nobody"))
    with pytest.raises(ValueError, match="contratos.id_cliente"):
        sinks.publish_operational(dict(ok, contratos=strangers), root, None, reset=True, check_principal=False)
    assert sinks.read_live(spark, root, "clientes").count() == 5


@pytest.mark.parametrize("step", ["stage_version", "replace_file", "_write_text"])
def test_failed_reload_keeps_the_old_data(spark, tmp_path, rel, monkeypatch, step):
    root = str(tmp_path / "db")
    tables = {"clientes": rel["clientes"], "servicios": rel["servicios"]}
    sinks.publish_operational(tables, root, check_principal=False, check_integrity=False)
    real = getattr(sinks, step)

    def fail(*args, **kwargs):
        if step == "stage_version":  # fails after a part has been written
            real({"clientes": args[0]["clientes"]}, args[1])
        raise OSError("injected")

    monkeypatch.setattr(sinks, step, fail)
    with pytest.raises(OSError, match="injected"):
        sinks.publish_operational({k: v.limit(1) for k, v in tables.items()}, root, reset=True, check_principal=False,
                                  check_integrity=False)
    assert sinks.read_live(spark, root, "clientes").count() == 6
    assert sinks.read_live(spark, root, "servicios").count() == rel["servicios"].count()
    monkeypatch.undo()
    sinks.publish_operational({k: v.limit(1) for k, v in tables.items()}, root, reset=True, check_principal=False,
                              check_integrity=False)
    assert sinks.read_live(spark, root, "clientes").count() == 1


def test_customer_table_access(spark, tmp_path):
    path = str(tmp_path / "clientes_prueba")
    assert customers.count_customers(spark, path) == 0
    for i in (2, 1):
        customers.insert_customer(spark, path, {"id_cliente": f"C{i}", "nombre": "x", "ciudad": "y",
                                                "tipo_contrato": "z", "plan": "p", "abandono": 0})
    assert [r["id_cliente"] for r in customers.all_customers(spark, path).collect()] == ["C1", "C2"]
    assert customers.customer_by_id(spark, path, "C2")["nombre"] == "x"
    assert customers.customer_by_id(spark, path, "C9") is None
    assert customers.count_customers(spark, path) == 2


def test_csv_export_sorted(spark, tmp_path, customers_df):
    out = str(tmp_path / "csv")
    sinks.write_csv(customers_df, out, ["id_cliente", "nombre"], ["id_cliente"])
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["id_cliente", "nombre"]
    assert sorted(r[0] for r in back.collect()) == ["K-01", "K-02", "K-03", "K-04", "K-05"]


def test_view_partition_independent(rel):
    def run(n):
        r = {k: v.repartition(n) for k, v in rel.items()}
        v = customer_behavior(r["clientes"], r["sucursales"], r["servicios"], r["contratos"], r["reclamos"],
                              r["facturas"], r["pagos"], dt.date(2026, 6, 28))
        return sorted(map(tuple, v.collect()), key=str)
    assert run(1) == run(5)


def test_empty_view_keeps_contract(rel):
    from churnlens.plans.behavior import VIEW_COLUMNS
    empty = rel["clientes"].limit(0)
    v = customer_behavior(empty, rel["sucursales"], rel["servicios"], rel["contratos"], rel["reclamos"],
                          rel["facturas"], rel["pagos"], dt.date(2026, 6, 28))
    assert v.count() == 0
    assert v.columns == [c for c in VIEW_COLUMNS if c != "edad"]


def test_admissible_rows_pass_the_gates(spark, tmp_path):
    """A bad row of each kind goes, with what refers to it; what is left is published with all checks."""
    def frame(rows, fields):
        return spark.createDataFrame(rows, fields)

    tables = {
        "servicios": frame([(1, "S1", "uno", 5.0), (2, "S2", "dos", -1.0)],
                           "id_servicio long, codigo string, nombre string, precio_mensual double"),
        "clientes": frame([("a", 3, 0), ("b", 9, 0), ("c", 4, 1), ("d", 4, 1), ("d", 2, 1), ("e", 1, 0), ("f", 2, 0)],
                          "id_cliente string, satisfaccion int, abandono int"),
        "contratos": frame([("k1", "a", 1, "activo", 9.0, 1), ("k2", "c", 2, "activo", 9.0, 1),
                            ("k3", "e", 1, "activo", 1.0, 1), ("k4", "e", 1, "activo", 1.0, 1),
                            ("k5", "b", 1, "activo", 1.0, 1), ("k6", "f", 1, "inactivo", 1.0, 1),
                            ("k7", "d", 1, "activo", 1.0, 1)],
                           "id_contrato string, id_cliente string, id_servicio long, estado string, "
                           "monto_mensual double, es_principal int"),
        "facturas": frame([(1, "a"), (2, "b"), (3, "a"), (3, "a")], "id_factura long, id_cliente string"),
        "pagos": frame([("p1", 1), ("p2", 2), ("p3", 3), ("p4", None)], "id_pago string, id_factura long"),
    }
    with pytest.raises(ValueError, match="integrity"):
        sinks.publish_operational(tables, str(tmp_path / "no"))
    kept = integrity.admissible(tables)
    assert {n: sorted(r[0] for r in df.collect()) for n, df in kept.items()} == {
        "servicios": [1], "clientes": ["a"], "contratos": ["k1"], "facturas": [1], "pagos": ["p1"]}
    root = str(tmp_path / "yes")
    assert sinks.publish_operational(kept, root)["clientes"] == 1
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert all(df.count() == 0 for df in integrity.admissible(empty).values())


def test_admissible_tables_are_read_by_column_and_once(spark):
    """What others refer to is kept as parquet, and no second branch looks for nulls that the row rules removed."""
    tables = {
        "clientes": spark.createDataFrame([("a", "A", 3, 0)], "id_cliente string, nombre string, satisfaccion int, abandono int"),
        "contratos": spark.createDataFrame([("k1", "a", 1, "activo", 9.0, 1)], "id_contrato string, id_cliente string, "
                                           "id_servicio long, estado string, monto_mensual double, es_principal int"),
        "facturas": spark.createDataFrame([(1, "a", "2026-01")], "id_factura long, id_cliente string, periodo string"),
        "pagos": spark.createDataFrame([("p1", 1)], "id_pago string, id_factura long"),
        "reclamos": spark.createDataFrame([("r1", "a", None), ("r2", "a", 7)],
                                          "id_reclamo string, id_cliente string, id_sucursal int"),
        "sucursales": spark.createDataFrame([(1, "uno")], "id_sucursal int, nombre string"),
    }
    kept = integrity.admissible(tables)
    for name in ("clientes", "contratos", "facturas"):
        assert kept[name].inputFiles(), name
    pagos = kept["pagos"]._jdf.queryExecution()
    assert "Union" not in pagos.optimizedPlan().toString()
    assert "ReadSchema: struct<id_factura:bigint>" in pagos.executedPlan().toString()
    assert [r["id_reclamo"] for r in kept["reclamos"].collect()] == ["r1"]  # no branch office is no broken reference


def test_stored_tables_are_refused_before_they_are_copied(spark, tmp_path, monkeypatch):
    copied, stage = [], sinks.stage_version
    monkeypatch.setattr(sinks, "stage_version", lambda tables, root: copied.append(sorted(tables)) or stage(tables, root))
    facturas = spark.createDataFrame([(1, "a"), (1, "a")], "id_factura long, id_cliente string")
    clientes = spark.createDataFrame([("a", 3, 0)], "id_cliente string, satisfaccion int, abandono int")
    root = str(tmp_path / "op")
    with pytest.raises(ValueError, match="facturas.pk_unico"):
        sinks.publish_operational({"clientes": clientes, "facturas": facturas}, root, check_first=True)
    assert not copied and sinks.live_version(spark, root) is None
    kept = {"clientes": clientes, "facturas": facturas.distinct()}
    assert sinks.publish_operational(kept, root, check_first=True)["clientes"] == 1
    assert copied == [["clientes", "facturas"]]
