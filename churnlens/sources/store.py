"""Materialised churn tables: the adapter's ETL written once per input snapshot.

The churn model is a set of stored operational tables (customers,
contracts, invoices, payments, complaints, ...).  ``churn_tables`` derives
them from the driver tables; this module writes that derivation once to the
cluster's shared checkpoint folder (``spark.checkpoint.dir``) and serves
every later query from the written parquet.  That also cuts the lineage:
an executor lost later recomputes from these files, not from the raw scans
and joins.

The snapshot key hashes the paths, sizes and modification times of all input
files (at any depth) and the compiled derivation code, so changed inputs or
rules are re-materialised.  Publication is atomic: write to a private folder,
then rename it to a name that must not exist yet (a concurrent writer that
loses the race discards its copy).  Only the newest snapshots of an input
folder are kept.  Tables that are mere renamings of an input (interactions)
are read from the input and not stored.  The text intake, which the view's
queries do not read, is added to its snapshot by the first query that does.
"""

from __future__ import annotations

import hashlib
import marshal
import os
import types
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, table_path
from churnlens.sources import adapter
from churnlens.sources.adapter import ChurnTables, churn_tables, interactions

DRIVER_INPUTS = ["customer", "nation", "region", "part", "orders", "lineitem", "events"]
TABLES = ["parametros", "sucursales", "servicios", "clientes", "contratos", "facturas", "pagos", "reclamos"]
#: Snapshots of one input folder that are kept.
KEEP_SNAPSHOTS = 2
INTAKE = "intake"
# name -> (range-partition keys, sort key).  The trailing unique id in each range key lets
# the range partitioner split a date holding a third of all rows over many files.  Contracts
# and payments, a row per line, are written where the join left them: active contracts lie in
# files of their own already, and all rows shuffled and sorted once more cost more than a scan saves.
CLUSTER_BY = {"facturas": (["fecha_emision", "id_factura"], "fecha_emision"),
              "reclamos": (["fecha", "id_reclamo"], "fecha")}


def _fs_and_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _code_of(module) -> bytes:
    """The compiled functions of a module: no source file is read, so a zipped package works."""
    found = sorted((n, f) for n, f in vars(module).items()
                   if isinstance(f, types.FunctionType) and f.__module__ == module.__name__)
    return b"".join(n.encode() + marshal.dumps((f.__code__.co_code, [c for c in f.__code__.co_consts if isinstance(
        c, (str, int, float, bytes, tuple)) and not isinstance(c, types.CodeType)])) for n, f in found)


def _derivation_version() -> bytes:
    """The derivation code itself is part of the snapshot: edited rules re-materialise."""
    from churnlens.plans import behavior
    from churnlens.sources import intake  # late: intake builds on this module's tables

    code = b"".join(map(_code_of, (adapter, intake, behavior)))
    return hashlib.sha256(code + repr(CLUSTER_BY).encode()).digest()


def snapshot_key(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha256(_derivation_version())
    for name in DRIVER_INPUTS:
        fs, p = _fs_and_path(spark, table_path(sf_dir, name))
        h.update(name.encode())
        if fs.exists(p):
            files, found = fs.listFiles(p, True), []
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
            h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:24]


def _input_folder(spark: SparkSession, sf_dir: str) -> str:
    return os.path.join(store_root(spark), hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16])


def store_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "churnlens_store")


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, p = _fs_and_path(spark, os.path.join(folder, "_COMPLETE"))
    return bool(fs.exists(p))


def materialize(spark: SparkSession, sf_dir: str) -> str:
    """Write the churn tables and the text intake for ``sf_dir`` once; return their folder."""
    from churnlens.sources.intake import customer_intake  # late: intake builds on this module's tables

    final = materialize_tables(spark, sf_dir)
    intake = os.path.join(final, INTAKE)
    fs, p = _fs_and_path(spark, intake)
    if not fs.exists(p):
        tmp = f"{final}.tmp-{uuid.uuid4().hex[:12]}"
        customer_intake(spark, sf_dir, tables=_read(spark, final, sf_dir)).write.mode("overwrite").parquet(tmp)
        if not _rename_new(spark, tmp, intake):
            fs.delete(_fs_and_path(spark, tmp)[1], True)  # another writer published first
    return final


def materialize_tables(spark: SparkSession, sf_dir: str) -> str:
    """Write the churn tables alone, which is all that most queries read; return their folder."""
    folder = _input_folder(spark, sf_dir)
    final = os.path.join(folder, snapshot_key(spark, sf_dir))
    if _complete(spark, final):
        return final
    tmp = final + ".tmp-" + uuid.uuid4().hex[:12]
    t = churn_tables(spark, sf_dir, persist_shared=True)
    try:
        for name, df in t.as_dict().items():
            if name not in TABLES:
                continue
            if name in CLUSTER_BY:
                # clustered by the dates that the view's windows filter on, so parquet min/max
                # statistics let those filters skip files and row groups
                range_keys, sort_key = CLUSTER_BY[name]
                df = df.repartitionByRange(*range_keys).sortWithinPartitions(sort_key)
            df.write.mode("overwrite").parquet(os.path.join(tmp, name))
    finally:
        t.release()
    fs, p = _fs_and_path(spark, os.path.join(tmp, "_COMPLETE"))
    fs.create(p, True).close()
    if not _rename_new(spark, tmp, final):
        if not _complete(spark, final):
            raise RuntimeError(f"{final} exists but is not complete; remove it")
        fs.delete(_fs_and_path(spark, tmp)[1], True)  # another writer published first
    _prune(spark, folder, final)
    return final


def _rename_new(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename a folder to a name that must not exist; False if it does (never moved into it)."""
    jvm = spark._jvm
    fs, target = _fs_and_path(spark, dst)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_fs_and_path(spark, src)[1], target, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception) and not fs.exists(target):
            raise
        return False
    return True


def _prune(spark: SparkSession, folder: str, current: str) -> None:
    """Delete all but the newest complete snapshots of an input folder; the current one always stays."""
    fs, p = _fs_and_path(spark, folder)
    old = sorted((st for st in fs.listStatus(p) if st.getPath().getName() != os.path.basename(current)
                  and _complete(spark, st.getPath().toString()) and ".tmp-" not in st.getPath().getName()),
                 key=lambda st: -st.getModificationTime())
    for st in old[KEEP_SNAPSHOTS - 1:]:
        fs.delete(st.getPath(), True)


def _read(spark: SparkSession, folder: str, sf_dir: str) -> ChurnTables:
    dfs = {n: spark.read.parquet(os.path.join(folder, n)) for n in TABLES}
    ref = dfs["parametros"].select(F.max("fecha_referencia")).first()[0]  # one scalar
    return ChurnTables(dfs["clientes"], dfs["sucursales"], dfs["servicios"], dfs["contratos"], dfs["facturas"],
                       dfs["pagos"], dfs["reclamos"], interactions(spark, sf_dir), dfs["parametros"],
                       F.lit(ref).cast("date"))


_OPENED: dict[tuple[str, str], ChurnTables] = {}


def _store_usable(spark: SparkSession) -> bool:
    """File-system access needs a classic (JVM-backed) session; otherwise derive lazily."""
    try:
        spark._jvm  # noqa: B018
        return spark._jvm is not None
    except Exception:  # noqa: BLE001
        return False


def stored_tables(spark: SparkSession, sf_dir: str) -> ChurnTables:
    """The churn tables of ``sf_dir``, materialised on first use.

    The opened DataFrames are reused within a session (keyed by the snapshot
    folder, so changed inputs are still picked up).  Without file-system
    access (e.g. a remote client session) the tables are derived lazily.
    """
    if not _store_usable(spark):
        return churn_tables(spark, sf_dir)
    folder = materialize_tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPENED:
        _OPENED[key] = _read(spark, folder, sf_dir)
    return _OPENED[key]


def stored_intake(spark: SparkSession, sf_dir: str):
    if not _store_usable(spark):
        from churnlens.sources.intake import customer_intake
        return customer_intake(spark, sf_dir)
    return spark.read.parquet(os.path.join(materialize(spark, sf_dir), INTAKE))
