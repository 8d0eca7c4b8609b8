"""A1/A2 customer intake: CSV reader and a flat text intake derived from the driver tables.

Both produce the flat 14-column customer contract as *text* columns (as a
CSV reader would), plus two ordering columns ``_src`` / ``_pos`` that fix the
input order needed by keep-first de-duplication (E1).  The order is captured
at read time, before any shuffle, so recomputation after an executor loss
gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions.coerce import na_tokens_to_null
from churnlens.plans.behavior import behavior_from_tables
from churnlens.sources.adapter import churn_tables, read_driver
from churnlens.sources.csv_splits import csv_records

ORDER_COLUMNS = ["_src", "_pos"]
INTAKE_COLUMNS = config.REQUIRED_COLUMNS + config.OPTIONAL_COLUMNS


def normalize_headers(df: DataFrame) -> DataFrame:
    """A2: strip blanks around column names."""
    return df.toDF(*[str(c).strip() for c in df.columns])


#: Column that marks a record with more fields than the header (surplus fields make a file invalid).
SURPLUS_COLUMN = "_sobrante"
_CORRUPT = "_registro"


def _plain_path(c):
    """A path without scheme and host, whose spelling differs between a listing and the scan."""
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _has_large_file(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than a scan's task is meant to read (listing metadata only)."""
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (longest or 0) > limit


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def read_customer_csv(spark: SparkSession, path: str, by_splits: bool | None = None) -> DataFrame:
    """A1: header CSV, every column text, missing-value tokens -> NULL, stripped headers.

    Quoted fields may hold commas, doubled quotes and line breaks.  Files up to the size of a scan's task are read
    whole, one task a file; larger ones by splits (``csv_splits``; ``by_splits`` decides otherwise).  Records with
    fewer fields than the header are filled up with NULL; one with more is marked in ``_sobrante`` instead of being
    cut.  Input order is (``_src``, ``_pos``): the rank of the file's path, joined from the file listing as data, and
    a number that increases within the file, assigned while reading and stable on recomputation.  An empty input
    raises, as a reader without a header must.
    """
    header = spark.read.options(header=True, multiLine=True, inferSchema=False, quote='"', escape='"').csv(path)
    names = header.columns
    if not names:
        raise ValueError(config.MSG_CSV_EMPTY)
    schema = ", ".join(f"{_quoted(c)} string" for c in [*names, _CORRUPT])
    if _has_large_file(spark, path) if by_splits is None else by_splits:
        raw = (csv_records(spark, path).select(F.from_csv("record", schema, _CSV).alias("r"), "file", "pos")
               .select("r.*", _plain_path(F.col("file")).alias("_file"), F.col("pos").alias("_pos")))
    else:
        raw = (spark.read.options(header=True, multiLine=True, columnPruning=False, **_CSV).schema(schema).csv(path)
               .select("*", _plain_path(F.col("_metadata.file_path")).alias("_file"),
                       F.monotonically_increasing_id().alias("_pos")))
    # a record of another length than the header is kept whole; without its quoted parts the commas count the fields
    commas = F.regexp_count(F.regexp_replace(F.col(_CORRUPT), '"([^"]|"")*"', ""), F.lit(","))
    rows = raw.select(*[F.col(_quoted(c)) for c in names],
                      F.coalesce(commas >= len(names), F.lit(False)).alias(SURPLUS_COLUMN), "_file", "_pos")
    files = sorted(header.inputFiles())  # listing metadata, no data pass
    ranks = (spark.createDataFrame([(f, i) for i, f in enumerate(files)], "f string, _src int")
             .select(_plain_path(F.col("f")).alias("_file"), "_src"))
    known = rows.join(ranks, "_file", "left")
    # a file that the listing spells differently keeps its rows, after the others and in path order of its hash
    src = F.coalesce("_src", F.lit(len(files)) + F.pmod(F.hash("_file"), F.lit(1 << 24))).cast("int")
    out = known.select(*[F.col(_quoted(c)) for c in names], SURPLUS_COLUMN, src.alias("_src"), "_pos")
    return na_tokens_to_null(normalize_headers(out))


def _text(c):
    return c.cast("string")


def _money_text(c):
    """Amounts as plain two-decimal text (no engine-specific float rendering)."""
    return F.round(c, 2).cast("decimal(20,2)").cast("string")


def customer_intake(spark: SparkSession, sf_dir: str, tables=None) -> DataFrame:
    """A flat text intake derived from the driver tables (for validation and cleaning).

    Batch 0 is the analytic view rendered as text (one row per customer,
    ordered by customer key).  Batch 1 renders every ``events`` row as a raw
    customer record keyed by user (``" U<user> "``), so it carries what a real
    upload carries: padded and blank ids, many repeats of one id, blank and
    badly spaced text, numbers stored as text, non-numeric tokens, negative
    and out-of-range values and invalid targets.  Both batches grow with the
    input tables.
    """
    view = behavior_from_tables(tables if tables is not None else churn_tables(spark, sf_dir))
    batch0 = view.select(
        *[(_money_text(F.col(c)) if c == "monto_mensual" else
           _text(F.col(c)) if c in view.columns else F.lit(None).cast("string")).alias(c)
          for c in INTAKE_COLUMNS],
        F.lit(0).alias("_src"), F.col("id_cliente").cast("bigint").alias("_pos"))

    ev = read_driver(spark, sf_dir, "events")
    et, val, uid = F.col("event_type"), F.col("value"), F.col("user_id").cast("string")
    cols = {
        "id_cliente": F.when((et == "error") & (val < 5), F.lit("   "))
                       .otherwise(F.concat(F.lit(" U"), uid, F.lit("  "))),
        "nombre": F.when(et == "view", F.lit(" ")).otherwise(F.concat(F.lit("  "), et, F.lit("   user "), uid)),
        "ciudad": F.concat(F.lit(" "), et, F.lit("-zone ")),
        "antiguedad_meses": _text(F.floor(val) - 10),
        "tipo_contrato": F.when(val >= 50, F.lit("")).otherwise(F.upper(et)),
        "plan": F.col("props"),
        "monto_mensual": _money_text(val * 1000),
        "reclamos_ultimos_6_meses": F.substring(F.col("props"), 7, 2),
        "pagos_atrasados": F.when(et == "click", F.lit("-1")).otherwise(F.lit("")),
        "dias_sin_uso": _text(F.hour("ts") - 3),
        "satisfaccion": _text(F.floor(val / 10)),
        "abandono": (F.when(et.isin("purchase", "view"), F.lit("0"))
                     .when(et == "signup", F.lit("1"))
                     .when(et == "click", F.lit(" 1 "))
                     .otherwise(F.lit("x"))),
        "edad": F.when(et == "view", F.concat(F.lit("\t"), uid)).when(et == "purchase", F.concat(uid, F.lit("\r\n")))
                 .otherwise(uid),
        "cantidad_servicios": _text(F.floor(val / 20)),
    }
    batch1 = ev.select(*[cols[c].alias(c) for c in INTAKE_COLUMNS],
                       F.lit(1).alias("_src"), F.col("event_id").cast("bigint").alias("_pos"))
    return batch0.unionByName(batch1)
