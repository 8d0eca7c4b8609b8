"""A6, A7, A9, A10, A1 flow: CSV export, prediction history, gated publish, operational reload.

Storage is plain files (parquet / CSV) under a root folder reachable by the
whole cluster.  File-system steps go through Hadoop, so the same code works
on local disk, HDFS or an object store.  Spark has no multi-table
transaction: a publication writes a new version folder, checks it, and then
replaces one small pointer file.  Readers follow the pointer, so a failure at
any point leaves the previous version readable; older versions are deleted
only after the switch.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config
from churnlens.operators import integrity, quality
from churnlens.sources.intake import SURPLUS_COLUMN, read_customer_csv

HISTORY_PARTITIONS = ["modelo", "version_modelo"]
RELOAD_REFUSED = ("There are already {n} customers under this root; pass reset=True to reload the operational tables "
                  "(the prediction history is kept unless reset_predictions=True).")
ORPHAN_HISTORY = ("The history holds predicciones of customers that the reload removes; nothing was changed. Pass "
                  "reset_predictions=True to start a new history.")
SURPLUS_FIELDS = "{n} registro(s) con mas campos que el encabezado."
POINTER = "_CURRENT"


# --------------------------------------------------------------------------- file-system helpers
def _jpath(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _jpath(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(_fs(spark, path).exists(_jpath(spark, path)))


def remove_path(spark: SparkSession, path: str) -> None:
    if path_exists(spark, path):
        _fs(spark, path).delete(_jpath(spark, path), True)


def replace_file(spark: SparkSession, src: str, dst: str) -> None:
    """Move a file onto another in one step (the target is either the old or the new file)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    conf = spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, dst).getUri(), conf)
    context.rename(_jpath(spark, src), _jpath(spark, dst), how)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_jpath(spark, path), True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_jpath(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def live_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the published version under ``root``, if there is one."""
    pointer = os.path.join(root, POINTER)
    return os.path.join(root, _read_text(spark, pointer).strip()) if path_exists(spark, pointer) else None


def live_path(spark: SparkSession, root: str, name: str) -> str | None:
    """Where the published table ``name`` lies, if it is published."""
    version = live_version(spark, root)
    path = version and os.path.join(version, name)
    return path if path and path_exists(spark, path) else None


def read_live(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = live_path(spark, root, name)
    if path is None:
        raise FileNotFoundError(f"no table {name} is published under {root}")
    return spark.read.parquet(path)


def stage_version(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables to a new version folder; nothing refers to it until ``switch_version``."""
    version = os.path.join(root, "v-" + _dt.datetime.now().strftime("%Y%m%d%H%M%S%f") + "-" + uuid.uuid4().hex[:8])
    for name, df in tables.items():
        df.write.parquet(os.path.join(version, name))
    return version


def switch_version(spark: SparkSession, root: str, version: str) -> None:
    """Publish a staged version by replacing the pointer, then delete the version it replaces."""
    old = live_version(spark, root)
    pointer = os.path.join(root, POINTER)
    fresh = pointer + "-" + uuid.uuid4().hex
    _write_text(spark, fresh, os.path.basename(version))
    replace_file(spark, fresh, pointer)
    if old and old != version:
        remove_path(spark, old)


# --------------------------------------------------------------------------- A6
def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order_by: list[str] | None = None) -> None:
    """Header CSV with a fixed column order; ``order_by`` gives a global sort (range-partitioned)."""
    out = df.select(*(columns or df.columns))
    if order_by:
        out = out.orderBy(*order_by)
    (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# --------------------------------------------------------------------------- A7
PREDICTION_COLUMNS = ["id_cliente", "probabilidad_churn", "nivel_riesgo", "fecha_prediccion", "corrida"]


def check_predictions(pred: DataFrame, clientes: DataFrame | None = None) -> None:
    """Refuse predictions that break the history's CHECK and NOT NULL rules or name an unknown customer."""
    bad = integrity.row_violations("predicciones", pred).where("violaciones > 0").collect()  # a few rules
    if bad:
        raise ValueError("predicciones: " + ", ".join(f"{r['regla']} ({r['violaciones']})" for r in bad))
    if clientes is not None:
        orphans = integrity.fk_orphans({"predicciones": pred, "clientes": clientes}).first()["huerfanos"]
        if orphans:
            raise ValueError(f"predicciones: {orphans} row(s) of unknown customers")


def write_predictions(pred: DataFrame, root: str, modelo: str = config.MODEL_NAME,
                      version: str = config.MODEL_VERSION, replace: bool = False,
                      clientes: DataFrame | None = None) -> int:
    """Append scored rows to the history (partitioned by model and version) as one run.

    Every run has an id of its own (``corrida``) beside its time.  The rows must satisfy the history's rules and,
    with ``clientes``, belong to known customers.  ``replace`` puts the rows in place of this (modelo,
    version_modelo) partition, also when there are none; other versions are untouched.  Returns the number of
    rows written, counted by the run's id.
    """
    spark = pred.sparkSession
    stamp, run = _dt.datetime.now().replace(microsecond=0), uuid.uuid4().hex
    rows = pred.select(
        F.col("id_cliente").cast("string").alias("id_cliente"),
        F.col("probabilidad_churn").cast("double").alias("probabilidad_churn"),
        F.col("nivel_riesgo").cast("string").alias("nivel_riesgo"),
        F.lit(stamp).cast("timestamp").alias("fecha_prediccion"), F.lit(run).alias("corrida"),
        F.lit(modelo).alias("modelo"), F.lit(version).alias("version_modelo"))
    check_predictions(rows, clientes)
    writer = rows.write.partitionBy(*HISTORY_PARTITIONS)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    else:
        writer.mode("append").parquet(root)
    n = read_history(spark, root).filter((F.col("corrida") == run) & (F.col("modelo") == modelo)).count()
    if replace and not n:  # a dynamic overwrite without rows touches no partition
        catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = "/".join(f"{c}={catalog.escapePathName(v)}"
                          for c, v in zip(HISTORY_PARTITIONS, (modelo, version), strict=True))
        remove_path(spark, os.path.join(root, folder))
    return n


def read_history(spark: SparkSession, root: str) -> DataFrame:
    fields = "id_cliente string, probabilidad_churn double, nivel_riesgo string, fecha_prediccion timestamp, " \
             "corrida string, modelo string, version_modelo string"
    return spark.read.schema(fields).parquet(root)


# --------------------------------------------------------------------------- A1 flow + A9
def load_and_validate_csv(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict]:
    """A1 + V3: read, strip headers, validate; the frame is returned only when valid.

    Read errors and empty files become an invalid verdict, never an exception.
    """
    base = {"es_valido": False, "errores": [], "advertencias": [], "resumen": {}}
    try:
        df = read_customer_csv(spark, path)
        cols = quality.data_columns(df)
    except Exception as exc:  # noqa: BLE001  (any read error is reported, as the reference does)
        msg = str(exc)
        if "UNABLE_TO_INFER_SCHEMA" in msg or "empty" in msg.lower() or msg == config.MSG_CSV_EMPTY:
            base["errores"].append(config.MSG_CSV_EMPTY)
        else:
            base["errores"].append(config.MSG_CSV_UNREADABLE + msg.splitlines()[0])
        return None, base
    if not cols:
        base["errores"].append(config.MSG_CSV_EMPTY)
        return None, base
    surplus = df.agg(F.count_if(SURPLUS_COLUMN), F.count(F.col(f"`{cols[0]}`"))).first()[0]
    if surplus:
        base["errores"].append(config.MSG_CSV_UNREADABLE + SURPLUS_FIELDS.format(n=surplus))
        return None, base
    df = df.drop(SURPLUS_COLUMN)
    verdict, report = quality.validate(df)
    v = verdict.first()
    result = {"es_valido": bool(v["es_valido"]), "errores": [e for e in (v["errores"] or "").split(" | ") if e],
              "advertencias": [], "resumen": {"filas": v["filas"], "columnas": v["columnas"]}}
    if report is not None:
        rows = report.collect()  # the report is bounded: a few rows per column
        result["advertencias"] = [r["mensaje"] for r in rows if r["mensaje"]]
        result["resumen"]["duplicados_id"] = next((r["n"] for r in rows if r["chequeo"] == "duplicados_id"), 0)
        result["resumen"]["valores_faltantes_por_columna"] = {r["columna"]: r["n"] for r in rows
                                                             if r["chequeo"] == "faltantes"}
    return (df if result["es_valido"] else None), result


def publish_intake(spark: SparkSession, df: DataFrame | None, verdict: dict, root: str, file_name: str) -> dict:
    """A valid load replaces the active data and discards stale cleaned data and report;
    an invalid one only records the attempt.  Every attempt appends one load-log row.
    """
    now = _dt.datetime.now().replace(microsecond=0)
    valid = bool(verdict.get("es_valido")) and df is not None
    if valid:  # a new version without cleaned data: the old ones go with the version they belong to
        switch_version(spark, root, stage_version({"activo": df}, root))
    log = spark.createDataFrame(
        [(file_name, valid, " | ".join(verdict.get("errores", [])), now)],
        "archivo string, es_valido boolean, errores string, fecha timestamp")
    log.write.mode("append").parquet(os.path.join(root, "cargas"))
    return {"datos_cargados": live_path(spark, root, "activo") is not None,
            "ultimo_archivo_procesado": file_name, "resultado_validacion": verdict,
            "datos_preparados": live_path(spark, root, "limpio") is not None}


def publish_clean(clean: DataFrame, report: DataFrame, root: str) -> None:
    """Persist the cleaned rows and their audit report in one version with the active data they came from."""
    spark = clean.sparkSession
    tables = {"limpio": clean, "reporte_limpieza": report}
    if live_path(spark, root, "activo"):
        tables["activo"] = read_live(spark, root, "activo")
    switch_version(spark, root, stage_version(tables, root))


# --------------------------------------------------------------------------- A10
def publish_operational(tables: dict[str, DataFrame], root: str, history_root: str | None = None,
                        reset: bool = False, reset_predictions: bool = False,
                        check_principal: bool = True, check_integrity: bool = True, check_first: bool = False) -> dict:
    """A10: reload the operational tables, keeping the prediction history by default.

    Refuses when customers already exist and ``reset`` is not set.  All tables are written to a new version and
    checked there: foreign keys (C7), row and key rules (C8), the principal-contract rule (C9) and customers that
    the kept history still names.  Only then is the pointer switched; on any failure the live version stays.
    ``check_first`` holds the same rules (but the history's) against the given tables before they are copied, so that
    tables which are stored already are refused without a copy of them.
    """
    spark = next(iter(tables.values())).sparkSession
    if live_path(spark, root, "clientes"):
        n = read_live(spark, root, "clientes").count()
        if n and not reset:
            raise RuntimeError(RELOAD_REFUSED.format(n=n))

    def gates(given: dict[str, DataFrame]) -> None:
        if check_integrity:
            integrity.assert_integrity(given)
        if check_principal and "clientes" in given and "contratos" in given:
            integrity.assert_principal_rule(given["clientes"], given["contratos"])

    if check_first:
        gates(tables)
    stage = stage_version(tables, root)
    try:
        staged = {n: spark.read.parquet(os.path.join(stage, n)) for n in tables}
        gates(staged)
        if history_root and path_exists(spark, history_root) and not reset_predictions:
            orphans = integrity.fk_orphans({"predicciones": read_history(spark, history_root),
                                            "clientes": staged["clientes"]}).first()["huerfanos"]
            if orphans:
                raise RuntimeError(ORPHAN_HISTORY + f" ({orphans} predicciones)")
        switch_version(spark, root, stage)
    except BaseException:
        if live_version(spark, root) != stage:
            remove_path(spark, stage)
        raise
    if history_root and reset_predictions:
        remove_path(spark, history_root)
    row = read_live(spark, root, "clientes").agg(F.count(F.lit(1)).alias("n"),
                                                 (F.avg("abandono") * 100).alias("tasa")).first()
    return {"clientes": row["n"], "tasa_abandono": row["tasa"]}
