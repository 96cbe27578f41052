"""Writers that publish whole results only: files, and callbacks with attempts."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

from .ranged import opened

ATTEMPTS = 4
WAIT_MS = 500  # after the nth failed attempt n * n times as long


@dataclass
class Written(WriterCommitMessage):
    """What a task that ended well leaves for the commit: the name of its list of files, or of its file."""

    name: str


def _remove(fs, paths: list[str]) -> None:
    for p in paths:
        try:
            fs.delete_file(p)
        except FileNotFoundError:
            pass


def _below(fs, base: str, mark: str) -> list[str]:
    from pyarrow import fs as pafs

    return [i.path for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if mark in i.path.rsplit("/", 1)[1]]


class PublishedWriter(DataSourceWriter):
    """Tasks write name.(job).(random).partial and list them; the commit renames what is listed, and nothing else stays."""

    def __init__(self, path: str):
        self.uri, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = opened(self.uri)
        fs.create_dir(base, recursive=True)
        done = []
        for row in iterator:
            name, data = row["name"], bytes(row["data"] or b"")
            if not name or name.startswith(".") or any(c in name for c in "/\\\n\t\0"):
                raise ValueError(f"{name!r} is no file's name")
            partial = f"{name}.{self.job}.{uuid.uuid4().hex}.partial"
            with fs.open_output_stream(f"{base}/{partial}", compression=None) as f:
                f.write(data)
            wanted = row["length"] if "length" in row.asDict() else len(data)
            (info,) = fs.get_file_info([f"{base}/{partial}"])
            if info.size != wanted:
                raise OSError(f"{name} has {info.size} bytes and not {wanted}")
            done.append(f"{partial}\t{name}")
        listed = f"list.{self.job}.{uuid.uuid4().hex}.partial"
        with fs.open_output_stream(f"{base}/{listed}", compression=None) as f:
            f.write("\n".join(done).encode())
        return Written(listed)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.uri)

        def publish(message: Written) -> None:
            with fs.open_input_stream(f"{base}/{message.name}", compression=None) as f:
                lines = f.read().decode().split("\n")
            for partial, name in (x.split("\t") for x in lines if x):
                fs.move(f"{base}/{partial}", f"{base}/{name}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(publish, [m for m in messages if m is not None]))
        self.abort(messages)  # lists, and what failed attempts left

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.uri)
        _remove(fs, _below(fs, base, f".{self.job}."))


class PublishedFiles(DataSource):
    """Writes each row (name, data) as a file of the folder path, whole or not at all; no file shows before all are whole.

    A row may have length: if its data has another, the write fails. Null data is an empty file. Of repeated
    names one stays. Tasks that still run when a write fails may leave files that end in .partial.
    """

    @classmethod
    def name(cls) -> str:
        return "published_files"

    def writer(self, schema, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(dict(self.options)["path"])


def publish(files: DataFrame, path: str) -> None:
    """Publishes files (name, data, perhaps length) in the folder path."""
    files.sparkSession.dataSource.register(PublishedFiles)
    files.write.format("published_files").option("path", path).mode("append").save()


def attempted(post: Callable[[str, str, int], bool], key: str, body: str, wait: Callable[[int], None]) -> dict:
    """What came of posting body: attempts, delays_ms and delivered. post(key, body, attempt) says whether it was taken; errors count as no."""
    delays: list[int] = []
    for n in range(1, ATTEMPTS + 1):
        try:
            if post(key, body, n):
                return {"attempts": n, "delays_ms": delays, "delivered": True}
        except Exception as error:  # whatever the transport raises
            failure = str(error)
        else:
            failure = "refused"
        if n < ATTEMPTS:
            delays.append(WAIT_MS * n * n)
            wait(delays[-1])
    return {"attempts": ATTEMPTS, "delays_ms": delays, "delivered": False, "error": failure}


class CallbackWriter(DataSourceWriter, DataSourceStreamWriter):
    """Tasks post rows and write what came of it; a commit shows it, once for each batch of a stream."""

    def __init__(self, path: str, post, wait):
        self.uri, self.post, self.wait, self.job = path, post, wait, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = opened(self.uri)
        fs.create_dir(base, recursive=True)
        name = f"part.{self.job}.{uuid.uuid4().hex}.partial"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for row in iterator:
                came = attempted(self.post, row["key"], row["body"], self.wait)
                f.write((json.dumps({"key": row["key"], "body": row["body"], **came}, ensure_ascii=False) + "\n").encode())
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int | None = None) -> None:  # noqa: N803
        """Without batchId the job's results show. A batch that was shown before isn't again: its results have its number in their names."""
        fs, base = opened(self.uri)
        whole = f"batch-{batchId}.whole" if batchId is not None else None
        if whole is None or not fs.get_file_info([f"{base}/{whole}"])[0].size:
            if whole is not None:
                _remove(fs, _below(fs, base, f"batch-{batchId}."))  # of a commit that broke off
            for k, m in enumerate(m for m in messages if m is not None):
                label = f"batch-{batchId}" if whole else f"job-{self.job}"
                fs.move(f"{base}/{m.name}", f"{base}/{label}.{k:05d}.jsonl")
            if whole is not None:
                with fs.open_output_stream(f"{base}/{whole}", compression=None) as f:
                    f.write(b"whole\n")
        self._clean(messages)

    def abort(self, messages: list[Written | None], batchId: int | None = None) -> None:  # noqa: N803
        self._clean(messages)

    def _clean(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.uri)
        _remove(fs, [p for p in _below(fs, base, f"part.{self.job}.")])


def _sleep(ms: int) -> None:
    time.sleep(ms / 1000)


def register_callbacks(spark: SparkSession, name: str, post: Callable[[str, str, int], bool], wait: Callable[[int], None] = _sleep) -> None:
    """A sink name for tables and streams of (key, body), with option path for the results.

    Each row is posted up to ATTEMPTS times, with growing waits between. The folder gets a JSON line a row: key,
    body, attempts, delays_ms, delivered. Rows of attempts that failed as tasks, or of a batch that a stream
    plays again, don't show twice; post sees them again and has the key to tell.
    """

    class Callbacks(DataSource):
        def writer(self, schema, overwrite: bool) -> CallbackWriter:
            return CallbackWriter(dict(self.options)["path"], post, wait)

        def streamWriter(self, schema, overwrite: bool) -> CallbackWriter:  # noqa: N802
            return CallbackWriter(dict(self.options)["path"], post, wait)

    Callbacks.name = classmethod(lambda cls: name)
    spark.dataSource.register(Callbacks)


RESULTS = "key string, body string, attempts int, delays_ms array<int>, delivered boolean, error string"


def callback_results(spark: SparkSession, path: str) -> DataFrame:
    """What came of the callbacks whose sink has this path."""
    return spark.read.schema(RESULTS).option("pathGlobFilter", "*.jsonl").json(path)
