"""Access to a customer table kept as parquet (insert, all ordered by id, by id, count)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config
from churnlens.sources.sinks import path_exists

SCRATCH_COLUMNS = ["id_cliente", "nombre", "ciudad", "tipo_contrato", "plan", "abandono"]
SCRATCH_SCHEMA = ("id_cliente string, nombre string, ciudad string, tipo_contrato string, plan string, "
                  "abandono int")


def insert_customer(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([tuple(record[c] for c in SCRATCH_COLUMNS)], SCRATCH_SCHEMA) \
        .write.mode("append").parquet(path)


def all_customers(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCRATCH_SCHEMA)
    return spark.read.parquet(path).select(*SCRATCH_COLUMNS).orderBy(config.ID_COLUMN)


def customer_by_id(spark: SparkSession, path: str, customer_id: str) -> dict | None:
    rows = all_customers(spark, path).filter(F.col(config.ID_COLUMN) == customer_id).limit(1).collect()
    return rows[0].asDict() if rows else None


def count_customers(spark: SparkSession, path: str) -> int:
    return all_customers(spark, path).count()
