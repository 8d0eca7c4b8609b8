"""B1 by an index: substring search that reads postings of 3-grams and only the blocks of rows they point to.

``build_index`` writes the rows in blocks (ranges of the id, one folder each), the postings (gram, block, row) sorted
by gram, and the number of rows of every gram.  ``search_index`` intersects the postings of the term's rarest grams;
the blocks of the hits are read by dynamic partition pruning and the rows are verified by the plain search, so
both give the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from churnlens import config
from churnlens.operators import explore

#: Characters of a gram; shorter terms are searched by a scan.
GRAM = 3
#: Rows of a block (mean).
BLOCK_ROWS = 250_000
#: Grams of a term that are counted, and how many of the rarest of them are intersected.
COUNTED, RAREST = 64, 4
#: Beyond this share of the rows the rarest gram rules out too little: a scan.
SCAN_SHARE = 0.2
#: Hits up to this number are broadcast (two numbers each); the gram's count bounds them beforehand.
BROADCAST_HITS = 500_000
WORK_COLUMNS = ["_bloque", "_fila"]


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters of the upper-cased text; none for null and shorter texts."""
    runs = F.regexp_extract_all(F.upper(text.cast("string")), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))
    return F.array_distinct(F.coalesce(runs, F.array().cast("array<string>")))


def build_index(df: DataFrame, path: str, id_col: str = config.ID_COLUMN, block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of ``df`` (id and name, those it has) to a new folder ``path``.

    The counts are written last: without them an index cannot be searched.  A hot gram (in all rows) lies in many
    ranges, as these go by gram, block and row.  Columns named like the index's own are refused.
    """
    spark, columns = df.sparkSession, [c for c in (id_col, "nombre") if c in df.columns]
    if clash := [c for c in WORK_COLUMNS if c in df.columns]:
        raise ValueError("columns of the index itself: " + ", ".join(clash))
    total = df.count()
    df.limit(0).write.parquet(os.path.join(path, "schema"))
    keys = columns or df.columns[:1]
    rows = (df.repartitionByRange(max(1, -(-total // block_rows)), *keys)
            .withColumns({"_bloque": F.spark_partition_id(), "_fila": F.monotonically_increasing_id()}))
    rows.write.partitionBy("_bloque").parquet(os.path.join(path, "rows"))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams_of(F.col(c)) for c in columns]))
    postings = _rows(spark, path).select(F.explode(grams).alias("gram"), *WORK_COLUMNS)
    by = ["gram", *WORK_COLUMNS]
    postings.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(os.path.join(path, "postings"))
    counts = _postings(spark, path).groupBy("gram").agg(F.count("*").alias("n"))
    whole = spark.range(1).select(F.lit("").alias("gram"), F.lit(total).cast("long").alias("n"))
    counts.unionByName(whole).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(
        os.path.join(path, "counts"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(os.path.join(path, "schema")).schema
    return spark.read.schema(schema.add("_fila", LongType()).add("_bloque", IntegerType())).parquet(os.path.join(path, "rows"))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, _bloque int, _fila long").parquet(os.path.join(path, "postings"))


def search_index(spark: SparkSession, path: str, term: str | None, id_col: str = config.ID_COLUMN) -> DataFrame:
    """The rows that ``explore.search`` gives for the indexed table.

    Blank terms and terms below three characters read all rows, and so do terms whose rarest gram is in more than
    ``SCAN_SHARE`` of them.  A term with a gram that no row has reads counts only.
    """
    rows = _rows(spark, path)
    text = str(term or "").strip().upper()
    wanted = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})[:COUNTED]
    found = explore.search(rows, term, id_col)
    counts = {r["gram"]: r["n"] for r in spark.read.schema("gram string, n long").parquet(
        os.path.join(path, "counts")).where(F.col("gram").isin("", *wanted)).collect()}  # at most COUNTED + 1 rows
    total = counts.pop("")
    if len(counts) < len(wanted):
        return found.where("false").drop(*WORK_COLUMNS)
    rarest = sorted(counts, key=lambda g: (counts[g], g))[:RAREST]
    if not rarest or counts[rarest[0]] > SCAN_SHARE * total:
        return found.drop(*WORK_COLUMNS)
    hits = (_postings(spark, path).where(F.col("gram").isin(*rarest)).groupBy(*WORK_COLUMNS)
            .agg(F.count("*").alias("k")).where(F.col("k") == len(rarest)).select(*WORK_COLUMNS))
    if counts[rarest[0]] <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return found.join(hits, WORK_COLUMNS, "left_semi").drop(*WORK_COLUMNS)
