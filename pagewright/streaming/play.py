"""Streams that play what is there, and end."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """conf (dots as __) for what starts inside."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def millis(at: pd.Series) -> list[int]:
    """Whole milliseconds of timestamps, as timers count."""
    return (at.astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[at.dt.unit]).tolist()


def table_stream(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """The rows of a Parquet table as a stream; files_each files a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may be a single file


def played(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream makes of what its sources hold now, as a table of the shared folder.

    The sink writes each batch once, whatever is repeated. Watermarks go on to the end of the input: what
    would come out only after a later event isn't there yet.
    """
    spark = stream.sparkSession
    at = shared(spark, name)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
