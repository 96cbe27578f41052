"""Files read by byte ranges: a data source with a partition a range or many small files, and blobs of many documents with an index."""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .files import MOST_BYTES

LEAST = 1 << 20  # bytes of a range
PARTS = 8  # ranges of a file at most
FILES = 256  # small files that one task reads, as long as they have no more than TOGETHER bytes
TOGETHER = 1 << 24
NAMED = 1 << 14  # ranges that one task tells of without reading them
BATCH = 1 << 20  # bytes after which rows are handed on
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, In: lambda v, some: v in some}
_PLANNED = ("file", "part", "start", "stop", "length")  # known before a byte is read


def opened(uri: str):
    """(file system, path) of a URI; local paths need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def cuts(length: int, least: int, parts: int) -> list[tuple[int, int]]:
    """(start, stop), stop included, of a file's ranges: up to parts of least bytes or more; an empty file has one, without bytes."""
    n = max(1, min(parts, length // least))
    return [(length * k // n, length * (k + 1) // n - 1) for k in range(n)]


@dataclass
class Ranges(InputPartition):
    """Ranges of one file that a task reads: one, or all wanted ones where the file comes as a stream."""

    file: str
    length: int
    parts: list[tuple[int, int, int]]
    mode: str

    def __init__(self, file, length, parts, mode):
        self.file, self.length, self.parts, self.mode = file, length, parts, mode


@dataclass
class Bundle(InputPartition):
    """Ranges of several files that one task reads one after another."""

    ranges: list[Ranges]

    def __init__(self, ranges):
        self.ranges = ranges


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.least, self.parts, self.most = (int(options.get(k, v)) for k, v in (("least", LEAST), ("parts", PARTS), ("most", MOST_BYTES)))
        self.stream, self.data = (options.get(k, v).lower() == "true" for k, v in (("stream", "false"), ("data", "true")))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on what is planned decide which ranges are read; the rest goes back."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PLANNED:
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, **range_) -> bool:
        return all(_TESTS[type(f)](range_[f.attribute[0]], f.value) for f in self.tests if f.attribute[0] in range_)

    def partitions(self) -> list[Ranges | Bundle]:
        """Lists the folder, or only looks up the files that a filter names."""
        from pyarrow import fs as pafs

        fs, base = opened(self.uri)
        named = [f.value if isinstance(f, In) else (f.value,) for f in self.tests if f.attribute == ("file",) and isinstance(f, (EqualTo, In))]
        if named:
            infos = fs.get_file_info([f"{base}/{name}" for name in sorted(set(named[0])) if ".." not in name.split("/")])
        else:
            infos = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        files = sorted((i.path[len(base) :].lstrip("/"), i.size) for i in infos if i.type == pafs.FileType.File)
        ranged, out = not self.stream and self._seeks(fs, base, files), []
        for name, length in files:
            if length > self.most:
                parts, mode = [(0, 0, -1)], "too large"
            else:
                parts, mode = [(k, a, z) for k, (a, z) in enumerate(cuts(length, self.least, self.parts))], "range" if ranged else "stream"
            parts = [p for p in parts if self._wanted(file=name, length=length, part=p[0], start=p[1], stop=p[2])]
            if mode == "range":
                out += [Ranges(name, length, [p], mode) for p in parts]
            elif parts:
                out.append(Ranges(name, length, parts, mode))
        return self._bundled(out) or [Ranges("", 0, [], "none")]

    def _bundled(self, ranges: list[Ranges]) -> list[Ranges | Bundle]:
        """Files with less than a range's least bytes together, the others alone; all together where nothing is read."""
        out: list[list[Ranges]] = []
        small, size, most = None, 0, FILES if self.data else NAMED
        for r in ranges:
            cost = 0 if not self.data or r.mode == "too large" else r.length
            if cost >= self.least:
                out.append([r])
            elif small is None or len(small) == most or size + cost > TOGETHER:
                small, size = [r], cost
                out.append(small)
            else:
                small.append(r)
                size += cost
        return [Bundle(b) if len(b) > 1 else b[0] for b in out]

    @staticmethod
    def _seeks(fs, base: str, files: list[tuple[str, int]]) -> bool:
        """Whether the store can read from the middle, asked with the first file that has bytes."""
        for name, length in files:
            if length:
                try:
                    with fs.open_input_file(f"{base}/{name}") as f:
                        return f.seekable()
                except NotImplementedError:
                    return False
        return True

    def read(self, partition: Ranges | Bundle) -> Iterator:
        import pyarrow as pa

        fs, base = opened(self.uri)
        kinds = dict(file=pa.string(), part=pa.int32(), start=pa.int64(), stop=pa.int64(), length=pa.int64(), mode=pa.string(), data=pa.binary())
        rows, size = [], 0
        for r in partition.ranges if isinstance(partition, Bundle) else [partition]:
            for part, start, stop, data in self._pieces(fs, f"{base}/{r.file}", r):
                rows.append((r.file, part, start, stop, r.length, r.mode, data))
                size += len(data or b"")
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def _pieces(self, fs, at: str, ranges: Ranges) -> Iterator[tuple]:
        """(part, start, stop, data) of one file's ranges."""
        if ranges.mode == "too large" or not self.data:
            yield from ((*p, None) for p in ranges.parts)
        elif ranges.mode == "range":
            for part, start, stop in ranges.parts:
                with fs.open_input_file(at) as f:
                    data = f.read_at(stop - start + 1, start) if stop >= start else b""
                if len(data) != stop - start + 1:
                    raise OSError(f"{at} ends before {stop}")
                yield part, start, stop, data
        elif ranges.parts:
            place = 0
            with fs.open_input_stream(at, compression=None) as f:
                for part, start, stop in ranges.parts:
                    while place < start:  # ranges that nobody asked for pass by
                        place += len(f.read(min(start - place, 1 << 20))) or start
                    data = f.read(stop - start + 1) if stop >= start else b""
                    if len(data) != stop - start + 1:
                        raise OSError(f"{at} ends before {stop}")
                    place = stop + 1
                    yield part, start, stop, data


class RangedFiles(DataSource):
    """Files below path, a row a byte range: (file, part, start, stop, length, mode, data), stop included.

    Options: path (a URI), least (bytes of a range), parts (ranges of a file at most), most (bytes of a file),
    stream, data. Filters on all but mode and data are applied before anything is read, so only the ranges that they leave
    are fetched. A range is a task's, but files of less than least bytes share one, up to FILES of them. A store that can't
    be read from the middle, or stream=true, gives one task a file, which reads it once from the front. An empty file
    has one range without bytes, and a file of more than most bytes a row without data. data=false only lists:
    no data, and nothing is read.
    """

    @classmethod
    def name(cls) -> str:
        return "ranged_files"

    def schema(self) -> str:
        return "file string, part int, start long, stop long, length long, mode string, data binary"

    def reader(self, schema) -> RangedReader:
        return RangedReader(dict(self.options))


def ranged(spark: SparkSession, path: str, **options) -> DataFrame:
    """The data source over path. Registers it with the session, and turns on its filters."""
    spark.dataSource.register(RangedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ranged_files").options(path=path, **options).load()


def whole_files(ranges: DataFrame) -> DataFrame:
    """(file, length, content, error) of files from their ranges: as when read at once, or in error if one is missing."""
    per = ranges.groupBy("file", "length").agg(F.array_sort(F.collect_list(F.struct("start", "data"))).alias("r"), F.sum(F.length("data")).alias("got"), F.max(F.col("mode") == "too large").alias("large"))  # PARTS at most
    content = F.aggregate("r", F.lit(b""), lambda a, r: F.concat(a, r["data"]))
    error = F.when(F.col("large"), "too large").when(F.col("got") != F.col("length"), "incomplete")
    return per.withColumn("error", error).select("file", "length", F.when(F.col("error").isNull(), content).alias("content"), "error")


ROLL = 1 << 28  # bytes after which a task begins another blob


def write_blobs(rows: DataFrame, folder: str, index: str) -> DataFrame:
    """Lays data of rows (id, data) end to end in blobs of folder; the table index says where: (id, file, start, length).

    Blobs have names of their own, and only those of tasks that ended well are in the index. Null data has no
    bytes; repeated ids keep a row each.
    """

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        try:
            for b in batches:
                places = []
                for data in b.column(1):
                    if out is None or out.tell() >= ROLL:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.blob"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    at, size = out.tell(), 0
                    if data.is_valid:
                        size = out.write(data.as_buffer())
                    places.append((name, at, size))
                cols = list(zip(*places)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    narrow = rows.select("id", F.col("data").cast("binary").alias("data"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, file string, start long, length long"
    narrow.mapInArrow(run, schema).write.parquet(index)
    return rows.sparkSession.read.schema(schema).parquet(index)


NEAR = 1 << 16  # bytes between two wanted places that are read along with them


def read_places(index: DataFrame, folder: str) -> DataFrame:
    """index (id, file, start, length) with data and fetched: only these places are read, near ones with one request.

    fetched is what a row's request read for it, with the gap before it. A place past its file's end fails.
    """
    kind = index.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        held, f = None, None
        for b in batches:
            ids, rows = b.column(0), list(zip(*(b.column(k).to_pylist() for k in (1, 2, 3))))
            out, k = [], 0
            while k < len(rows):
                name, low, size = rows[k]
                high, last = low + size, k + 1
                while last < len(rows) and rows[last][0] == name and rows[last][1] - high <= NEAR and rows[last][1] + rows[last][2] - low <= 1 << 24:
                    high, last = max(high, rows[last][1] + rows[last][2]), last + 1
                if held != name:
                    if f is not None:
                        f.close()
                    held, f = name, fs.open_input_file(f"{base}/{name}")
                data, before = f.read_at(high - low, low), low
                if len(data) != high - low:
                    raise OSError(f"{name} ends before {high}")
                for _, at, n in rows[k:last]:
                    out.append((data[at - low : at - low + n], max(0, at + n - before)))
                    before = max(before, at + n)
                k = last
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64())], names=["id", "data", "fetched"])
        if f is not None:
            f.close()

    places = index.select("id", "file", "start", "length").repartition("file").sortWithinPartitions("file", "start")
    return places.mapInArrow(run, f"id {kind}, data binary, fetched long")
