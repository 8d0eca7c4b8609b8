"""churnlens: customer-churn analytics as Spark DataFrame / SQL / pyspark.ml jobs."""

__all__ = ["config"]
