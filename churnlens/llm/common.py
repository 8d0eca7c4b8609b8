"""Shared helpers of the training-data operators: tables, scratch tables in the shared folder, words."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, table_path

#: A word: a run of characters that are not ASCII white space (fixed by the operators' contracts).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def workers_find_package(spark: SparkSession) -> None:
    """Let local Python workers import this package when the driver runs outside the repository.

    On a cluster the package is installed or shipped with ``--py-files``; the extra path is then unused.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (shared by driver and executors)."""
    workers_find_package(spark)
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def quoted(name: str) -> str:
    """A column name as a quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def own_columns_apart(docs: DataFrame, used: list[str], work: Callable[[DataFrame], DataFrame],
                      added: tuple[str, ...] = ()) -> DataFrame:
    """``work(docs)`` with the columns it does not use under names that cannot clash with its own ones.

    Returns the columns of ``docs`` unchanged, then ``added``; a column of ``docs`` named like an added one is
    replaced.
    """
    token = uuid.uuid4().hex
    names = {c: c if c in used else f"own_{token}_{i}" for i, c in enumerate(docs.columns) if c not in added}
    out = work(docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]))
    return out.select(*[F.col(quoted(n)).alias(c) for c, n in names.items()], *added)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
