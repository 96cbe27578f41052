"""Tables and files that stages hand to each other through the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []  # folders made inside each swept()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def root(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder, as there the driver is the only
    machine; a cluster gets an error, because executors would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or getattr(spark, "_pagewright_root", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
        spark._pagewright_root = base
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/pagewright-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(folder)
    return folder


@contextmanager
def swept(spark: SparkSession):
    """Folders that operators make inside are removed at its end: write what they return before."""
    _open.append([])
    try:
        yield
    finally:
        drop(*_open.pop(), spark=spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet and reads it back: cuts the lineage, and survives lost executors.

    Shuffle files of the write go when it ends. Otherwise they would stay until the driver collects garbage,
    so that disk would hold the shuffles of many steps.
    """
    path, conf = f"{root(df.sparkSession)}/{name}", df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[made] = path
    return made


def _at(spark: SparkSession, path: str):
    """(Hadoop's file system, its path): what Spark itself reads and writes with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Removes materialized tables, or folders (with their session), once what was made of them has been written."""
    for t in tables:
        path = t if isinstance(t, str) else _places.pop(t, None)
        if path:
            fs, place = _at(spark or t.sparkSession, path)
            fs.delete(place, True)


def is_table(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def opened(uri: str):
    """(file system, path) of a URI for Python tasks; local paths need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
