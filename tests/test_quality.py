"""V1-V3, D16-D19 and the CSV intake."""

import os
import tempfile

from churnlens.operators import quality
from churnlens.sources import sinks


def _verdict(df):
    return quality.structure_verdict(df).first()


def _warnings(df):
    return [r["mensaje"] for r in quality.quality_report(df).collect() if r["mensaje"]]


def test_valid_frame_has_no_errors_or_warnings(customers):
    v = _verdict(customers)
    assert v["es_valido"] and v["errores"] == ""
    assert _warnings(customers) == []


def test_empty_frame_is_invalid(customers):
    v = _verdict(customers.limit(0))
    assert not v["es_valido"] and "no contiene filas" in v["errores"]


def test_missing_required_columns(customers):
    v = _verdict(customers.drop("nombre", "ciudad"))
    assert not v["es_valido"] and "Faltan columnas obligatorias: nombre, ciudad" in v["errores"]


def test_duplicates_missing_and_bad_target(spark, customers):
    from pyspark.sql import functions as F
    df = customers.withColumn("id_cliente", F.when(F.col("id_cliente") == "K-02", "K-01")
                              .otherwise(F.col("id_cliente")))
    df = df.withColumn("nombre", F.when(F.col("id_cliente") == "K-03", None).otherwise(F.col("nombre")))
    df = df.withColumn("abandono", F.when(F.col("id_cliente") == "K-04", 2).otherwise(F.col("abandono")))
    rep = {(r["chequeo"], r["columna"]): r for r in quality.quality_report(df).collect()}
    assert rep[("duplicados_id", None)]["n"] == 1
    assert rep[("faltantes", "nombre")]["n"] == 1
    w = _warnings(df)
    assert any("duplicados" in m for m in w) and any("faltantes" in m for m in w)
    assert any("distintos de 0 y 1" in m for m in w)


def test_ranges_and_text_numbers(spark):
    df = spark.createDataFrame([("A", "-1", "7", "130", "x"), ("B", "2", "0", "-3", "1")],
                               "id_cliente string, monto_mensual string, satisfaccion string, edad string, "
                               "abandono string")
    rep = {(r["chequeo"], r["columna"]): r["n"] for r in quality.quality_report(df).collect()}
    assert rep[("negativos", "monto_mensual")] == 1
    assert rep[("satisfaccion_fuera_rango", "satisfaccion")] == 2
    assert rep[("edad_fuera_rango", "edad")] == 2
    assert rep[("no_numericos", "abandono")] == 1


def _csv(text):
    d = tempfile.mkdtemp(prefix="churnlens-csv-")
    p = os.path.join(d, "f.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


HEADER = ("id_cliente, nombre,ciudad,antiguedad_meses,tipo_contrato,plan,monto_mensual,reclamos_ultimos_6_meses,"
          "pagos_atrasados,dias_sin_uso,satisfaccion,abandono,edad,cantidad_servicios\n")


def test_csv_load_valid_and_header_trim(spark):
    p = _csv(HEADER + "K-01,Elsa Brandt,Puerto Norte,24,Fijo,Movil 20,210,0,0,2,5,0,34,3\n"
             "K-02,Ivo Marchetti,Laguna Alta,8,Libre,Casa 500,95,2,1,14,3,1,NA,1\n")
    df, verdict = sinks.load_and_validate_csv(spark, p)
    assert verdict["es_valido"] and df is not None
    assert "nombre" in df.columns and df.count() == 2
    assert verdict["resumen"]["valores_faltantes_por_columna"] == {"edad": 1}


def test_csv_two_columns_is_invalid(spark):
    df, verdict = sinks.load_and_validate_csv(spark, _csv("a,b\n1,2\n"))
    assert df is None and not verdict["es_valido"]
    assert any("Faltan columnas obligatorias" in e for e in verdict["errores"])


def test_csv_empty_file_is_invalid(spark):
    df, verdict = sinks.load_and_validate_csv(spark, _csv(""))
    assert df is None and not verdict["es_valido"] and verdict["errores"]


def test_gated_publish(spark, customers):
    root = tempfile.mkdtemp(prefix="churnlens-pub-")
    ok = {"es_valido": True, "errores": []}
    st = sinks.publish_intake(spark, customers, ok, root, "uno.csv")
    assert st["datos_cargados"] and not st["datos_preparados"]
    sinks.publish_clean(customers, customers.limit(1), root)
    bad = {"es_valido": False, "errores": ["x"]}
    st = sinks.publish_intake(spark, None, bad, root, "malo.csv")
    assert st["datos_cargados"] and st["datos_preparados"]  # invalid load keeps active and cleaned data
    assert sinks.read_live(spark, root, "activo").count() == 5
    st = sinks.publish_intake(spark, customers.limit(2), ok, root, "dos.csv")
    assert not st["datos_preparados"]  # a valid load discards stale cleaned data
    assert sinks.read_live(spark, root, "activo").count() == 2
    assert spark.read.parquet(os.path.join(root, "cargas")).count() == 3
