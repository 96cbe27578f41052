"""Uploads: bodies of many parts between boundary lines, read by byte ranges so that many tasks share one body."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from .ranged import opened

CHUNK = 1 << 20  # bytes read at a time while a boundary is looked for
_NAMES = re.compile(rb'(?i)\b(name|filename)="([^"]*)"')


def write_bodies(parts: DataFrame, folder: str, listing: str) -> DataFrame:
    """Bodies of parts (filename, data), one a task, in folder; the table listing has (file, length) of those that are whole.

    Null data is an empty part.
    """

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, name, line = None, f"{uuid.uuid4().hex}.body", uuid.uuid4().hex.encode()
        try:
            for b in batches:
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                for filename, data in zip(b.column(0).to_pylist(), b.column(1)):
                    head = f'Content-Disposition: form-data; name="file"; filename="{filename}"\r\nContent-Type: application/pdf'
                    out.write(b"--" + line + b"\r\n" + head.encode() + b"\r\n\r\n")
                    if data.is_valid:
                        out.write(data.as_buffer())
                    out.write(b"\r\n")
            if out is not None:
                out.write(b"--" + line + b"--\r\n")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.tell()])], names=["file", "length"])
        finally:
            if out is not None:
                out.close()

    narrow = parts.select("filename", F.col("data").cast("binary").alias("data"))
    narrow.mapInArrow(run, "file string, length long").write.parquet(listing)
    return parts.sparkSession.read.schema("file string, length long").parquet(listing)


class Body:
    """A body that is read from some place on."""

    def __init__(self, file, length: int):
        self.file, self.length = file, length
        first = file.read_at(min(length, 300), 0)
        if not first.startswith(b"--") or b"\r\n" not in first:
            raise ValueError("the body doesn't begin with a boundary")
        self.mark = b"\r\n" + first[: first.index(b"\r\n")]

    def next_mark(self, at: int, stop: int | None = None) -> int:
        """Where the first boundary at or after at begins, of those before stop; -1 without. The first line's begins at -2."""
        if at <= -2:
            return -2
        at, stop = max(at, 0), self.length if stop is None else min(stop, self.length)
        while at < stop:
            size = min(CHUNK, stop - at) + len(self.mark) - 1  # so that one across the edge is seen
            found = self.file.read_at(min(size, self.length - at), at).find(self.mark)
            if found >= 0:
                return at + found
            at += CHUNK
        return -1

    def part(self, at: int) -> tuple[dict[str, str], bytes | None, int] | None:
        """(names, data, next boundary) of the part whose boundary begins at at; None at the closing one. Without a next boundary data is None."""
        begin = at + len(self.mark)
        if self.file.read_at(min(2, self.length - begin), begin) == b"--":
            return None
        stop = self.next_mark(begin)
        if stop < 0:
            return {}, None, -1
        raw = self.file.read_at(stop - begin, begin)
        head, _, data = raw.partition(b"\r\n\r\n")
        return {k.decode().lower(): v.decode() for k, v in _NAMES.findall(head)}, data, stop


def read_uploads(bodies: DataFrame, folder: str, size: int = 64 << 20) -> DataFrame:
    """(file, at, name, filename, data, error) of the parts of bodies (file, length), each once, whatever the size of ranges.

    A range of size bytes gives the parts whose boundary begins in it: its task looks for the first one from
    the range's start, and reads the last part on past the range's end. A part without a boundary after it is in error; a
    body that doesn't begin with a boundary fails.
    """

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        for b in batches:
            for file, length, start in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{base}/{file}") as f:
                    body = Body(f, length)
                    # the first line has no line break before it: it begins at -2, in the first range
                    at = body.next_mark(start if start else -2, start + size)
                    while at != -1 and at < start + size:
                        part = body.part(at)
                        if part is None:
                            break
                        names, data, after = part
                        cols = [file], [at], [names.get("name")], [names.get("filename")], [data], ["incomplete" if data is None else None]
                        kinds = pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "at", "name", "filename", "data", "error"])
                        at = after

    ranges = bodies.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))).alias("start"))
    return ranges.repartition("file", "start").mapInArrow(run, "file string, at long, name string, filename string, data binary, error string")
