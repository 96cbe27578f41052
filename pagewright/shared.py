"""Places and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a session on one machine gets a folder of its own; a cluster gets an error, because
    executors would not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_pagewright_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext._pagewright_shared = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: what several parts of a plan use is computed once, and survives lost executors."""
    at = shared(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
