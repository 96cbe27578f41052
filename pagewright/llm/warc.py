"""WARC archives with a two-level capture index.

Records are gzip members of archives in the shared folder. Their reversed-host URL keys are sorted into
shards of compressed blocks; a sparse directory has each block's first key. A look-up bisects the shards,
the directory and the block, and then reads the record's byte range.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, functions as F

from .scratch import materialize, opened, root
from .sieve import flagged

LEAST = 100  # bytes of a payload that others may refer to
BLOCK = 256  # index lines of a compressed block
SHARDS = 1024  # index shards at most: all that the driver and every task hold of the index
ROLL = 1 << 30  # bytes after which a task begins another archive
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:pagewright:page:"
_SAFE = "".join(chr(c) for c in range(33, 127))


def surt(url: str | None) -> str:
    """Reversed-host key of a URL; '-' for a null.

    It is made from the URL as a record's header has it, percent-encoded where it isn't printable ASCII, so a
    raw URL and its record's have one key. What can't be parsed is its own key.
    """
    if url is None:
        return "-"
    quoted = quote(url, safe=_SAFE)
    try:
        u = urlsplit(quoted)
        host, port = u.hostname or "", f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return quoted
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){tail}"


def record(page, url: str | None, payload: bytes, digest: str, first=None, first_url: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit if first says whose payload it repeats."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{first}>"]
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(first_url, safe=_SAFE)}")
    block = HTTP % len(payload) + (payload if first is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header, payload) of a record; a revisit's payload is empty."""
    raw = zlib.decompress(member, 31)
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def digest_of(head: dict[str, str]) -> str:
    return head["WARC-Payload-Digest"].removeprefix("sha256:")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns (surt, page_id, archive, at, size).

    Of rows with equal payloads of LEAST bytes or more, those with the smallest page_id are responses and
    the others revisit it; a null page_id is a response only where its group has no other. Rows that repeat
    a page_id get a record each: with equal payloads all those of the smallest page_id are responses, with
    unlike ones each belongs to the group of its own payload. A null url has the key '-', a null html is an
    empty payload; no rows give no archives. A task's files have names of their own, and only those of tasks
    that ended well are in the returned table.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= LEAST
    groups = p.filter(large).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    firsts = materialize(groups.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc_firsts")
    # only payloads that may have a copy move to meet their group
    p = flagged(p, firsts.select("digest"), F.xxhash64("digest"), "shared")
    refers = large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id")))
    shared = p.filter("shared").join(firsts.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left").withColumn("first", F.when(refers, F.col("first")))
    alone = p.filter("NOT shared").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    columns = ["page_id", "url", "html", "digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")]
    p = shared.select(*columns).union(alone.select(*columns))

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        try:
            for b in batches:
                rows = [[], [], [], [], []]
                for page, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or out.tell() >= ROLL:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page, url, html, digest, first, first_url)
                    for c, v in zip(rows, (surt(url), page, name, out.tell(), len(member))):
                        c.append(v)
                    out.write(member)
                kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["surt", "page_id", "archive", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return materialize(p.mapInArrow(run, "surt string, page_id long, archive string, at long, size long"), "warc_records")


def _key(surt_: str, page) -> tuple[bytes, int]:
    return surt_.encode(), -(1 << 63) if page is None else page


class Index:
    """Shards by first key; made by write_index(), read by tasks."""

    def __init__(self, folder: str, shards: list[tuple[tuple[bytes, int], tuple[bytes, int], str]]):
        self.folder, self.shards = folder, sorted(shards)

    def reader(self) -> "Reader":
        return Reader(self)


def write_index(records: DataFrame, folder: str) -> Index:
    """Sorts the captures by key over at most SHARDS shards and writes their blocks and directories.

    A null page_id comes before others of its key; captures that share a key are all kept; no captures give no shard.
    """
    spark = records.sparkSession
    n = max(1, min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = records.repartitionByRange(n, "surt", "page_id", "archive", "at").sortWithinPartitions("surt", "page_id", "archive", "at")

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name, out, lines, directory, first, last = uuid.uuid4().hex, None, [], [], None, None

        def cut():
            nonlocal lines
            data = zlib.compress("\n".join(lines).encode())
            directory.append(f"{lines[0].rsplit(chr(9), 3)[0]}\t{out.tell()}\t{len(data)}")
            out.write(data)
            lines = []

        try:
            for b in batches:
                out = out or fs.open_output_stream(f"{base}/{name}.blocks", compression=None)
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    last = row[:2]
                    first = first or last
                    lines.append("\t".join("" if v is None else str(v) for v in row))
                    if len(lines) == BLOCK:
                        cut()
            if lines:
                cut()
        finally:
            if out is not None:
                out.close()
        if first:
            with fs.open_output_stream(f"{base}/{name}.directory", compression=None) as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, *first, *last), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["name", "a", "ap", "z", "zp"])

    shards = materialize(ordered.mapInArrow(run, "name string, a string, ap long, z string, zp long"), "warc_shards").collect()  # at most SHARDS rows
    return Index(folder, [(_key(r["a"], r["ap"]), _key(r["z"], r["zp"]), r["name"]) for r in shards])


class _Recent(OrderedDict):
    def __init__(self, most: int, make, drop=None):
        super().__init__()
        self.most, self.make, self.drop = most, make, drop

    def at(self, key):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = self.make(key)
            if len(self) > self.most:
                _, old = self.popitem(last=False)
                if self.drop:
                    self.drop(old)
        return self[key]


class Reader:
    """Look-ups in a task; keeps a few directories, blocks and open archives."""

    def __init__(self, index: Index):
        self.index = index
        self.fs, self.base = opened(index.folder)
        self.ends = [z for _, z, _ in index.shards]
        self.directories = _Recent(8, self._directory)
        self.blocks = _Recent(64, self._block)
        self.files = _Recent(64, lambda name: self.fs.open_input_file(name), lambda f: f.close())

    def _directory(self, name: str):
        with self.fs.open_input_file(f"{self.base}/{name}.directory") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        return [_key(s, int(p) if p else None) for s, p, _, _ in rows], [(int(a), int(n)) for _, _, a, n in rows]

    def _block(self, of: tuple[str, int, int]):
        name, at, size = of
        rows = [x.split("\t") for x in zlib.decompress(self.files.at(f"{self.base}/{name}.blocks").read_at(size, at)).decode().split("\n")]
        return [_key(s, int(p) if p else None) for s, p, *_ in rows], [(a, int(o), int(n)) for _, _, a, o, n in rows]

    def find(self, surt_: str, page) -> list[tuple[str, int, int]]:
        """(archive, at, size) of all captures with this key."""
        key, out = _key(surt_, page), []
        for shard in range(bisect.bisect_left(self.ends, key), len(self.ends)):
            first, _, name = self.index.shards[shard]
            if first > key:
                break
            starts, places = self.directories.at(name)
            for k in range(max(0, bisect.bisect_left(starts, key) - 1), len(starts)):
                if starts[k] > key:
                    break
                keys, captures = self.blocks.at((name, *places[k]))
                out += captures[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        return out

    def read(self, folder: str, capture: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        archive, at, size = capture
        return parsed(self.files.at(f"{opened(folder)[1]}/{archive}").read_at(size, at))


def read_captures(wanted: DataFrame, index: Index, archives: str) -> DataFrame:
    """Per capture of the keys in wanted (url, page_id): page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Keys are sorted first, so that a task reads neighbouring blocks; repeated keys are looked up once. A
    revisit is followed through the index to the response that has the digest it names, also where several
    captures share that response's url and page_id; without one the job fails. Keys without capture give no row.
    """

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["surt", "page_id"])

    def run(batches):
        import pyarrow as pa

        reader, before = index.reader(), None

        def response(of):
            """Of the captures under a key, which may repeat with other payloads, the response that has the digest."""
            *key, digest = of
            for capture in reader.find(*key):
                head, payload = reader.read(archives, capture)
                if head["WARC-Type"] == "response" and digest_of(head) == digest:
                    return len(payload), hashlib.sha256(payload).hexdigest()
            raise LookupError(f"no response for {of}")

        known = _Recent(4096, response)
        for b in batches:
            found = []
            for key in zip(*(c.to_pylist() for c in b.columns)):
                if key != before:
                    found += reader.find(*key)
                    before = key
            rows = []
            for capture in sorted(found):
                head, payload = reader.read(archives, capture)
                page = head["WARC-Record-ID"][len(ID) + 1 : -1]
                digest = digest_of(head)
                refers = None
                if head["WARC-Type"] == "revisit":
                    refers = int(head["WARC-Refers-To"][len(ID) + 1 : -1])
                    size, real = known.at((surt(head.get("WARC-Refers-To-Target-URI")), refers, digest))
                else:
                    size, real = len(payload), hashlib.sha256(payload).hexdigest()
                if real != digest:
                    raise ValueError(f"page {page}: its payload has another digest than its record says")
                rows.append((int(page) if page else None, size, digest, head["WARC-Type"], refers, head.get("WARC-Target-URI")))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    keys = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keyed, "surt string, page_id long")
    n = max(1, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = keys.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return keys.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1_warc_captures(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = root(spark)
    index = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    found = read_captures(pages, index, f"{folder}/archives")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
