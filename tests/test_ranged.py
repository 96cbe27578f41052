"""Reading by ranges, and writers that show whole results only."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains, StringStartsWith

from pagewright.sources import files, publish, ranged


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "files"
    (at / "deep").mkdir(parents=True)
    for name, size in (("a.bin", 1000), ("b.bin", 95), ("empty.bin", 0), ("deep/c.bin", 350), ("large.bin", 5000)):
        (at / name).write_bytes(bytes((i * 7 + len(name)) % 256 for i in range(size)))
    return at


def test_ranges_make_whole_files(spark, folder):
    for stream in ("false", "true"):
        df = ranged.ranged(spark, folder.as_uri(), least=100, parts=4, most=2000, stream=stream)
        got = {r["file"]: r for r in ranged.whole_files(df).collect()}
        assert set(got) == {"a.bin", "b.bin", "empty.bin", "deep/c.bin", "large.bin"}
        for name, r in got.items():
            if name == "large.bin":
                assert (r["content"], r["error"], r["length"]) == (None, "too large", 5000)
            else:
                assert (bytes(r["content"]), r["error"]) == ((folder / name).read_bytes(), None)
    parts = df.filter("file = 'a.bin'").select("part", "start", "stop", "mode").orderBy("part").collect()
    assert [tuple(p) for p in parts] == [(k, 250 * k, 250 * k + 249, "stream") for k in range(4)]
    lost = ranged.whole_files(df.filter("part != 2")).filter("file = 'a.bin'").first()
    assert (lost["content"], lost["error"]) == (None, "incomplete")


def test_filters_decide_what_is_read(spark, folder):
    reader = ranged.RangedReader({"path": folder.as_uri(), "least": "100", "parts": "4"})
    back = list(reader.pushFilters([EqualTo(("file",), "a.bin"), GreaterThanOrEqual(("stop",), 300), LessThan(("start",), 600), StringContains(("mode",), "r")]))
    assert [type(f) for f in back] == [StringContains]
    planned = reader.partitions()
    assert [(p.file, p.parts) for p in planned] == [("a.bin", [(1, 250, 499)]), ("a.bin", [(2, 500, 749)])]
    assert sum(len(b.column(6)[0].as_py()) for p in planned for b in reader.read(p)) == 500
    for tests, found in (([In(("file",), ("b.bin", "none.bin", "../files/a.bin"))], ["b.bin"]), ([StringStartsWith(("file",), "deep/")], ["deep/c.bin"] * 3), ([EqualTo(("file",), "none")], [""])):
        reader = ranged.RangedReader({"path": folder.as_uri(), "least": "100"})
        assert list(reader.pushFilters(tests)) == []
        assert [p.file for p in reader.partitions()] == found
    df = ranged.ranged(spark, folder.as_uri(), least=100, parts=4).filter("file = 'a.bin' AND start >= 500")
    assert df.rdd.getNumPartitions() == 2
    assert df.agg(F.sum(F.length("data"))).first()[0] == 500


def test_a_stream_passes_by_what_nobody_wants(folder):
    reader = ranged.RangedReader({"path": folder.as_uri(), "least": "100", "parts": "4", "stream": "true"})
    list(reader.pushFilters([EqualTo(("file",), "a.bin"), EqualTo(("part",), 3)]))
    (p,) = reader.partitions()
    (batch,) = reader.read(p)
    assert batch.column(6)[0].as_py() == (folder / "a.bin").read_bytes()[750:]


@pytest.mark.parametrize("stream", ["false", "true"])
def test_small_files_share_a_task(spark, tmp_path, stream):
    """A task a file would be as many tasks as pages; a file of a range's least bytes or more still has its own."""
    sizes = {f"small{k:03d}": k % 50 for k in range(ranged.FILES + 50)} | {"wide": 4000, "large": 100_000}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(bytes([size % 251]) * size)
    df = ranged.ranged(spark, tmp_path.as_uri(), parts=4, least=1000, most=50_000, stream=stream)
    assert df.rdd.getNumPartitions() <= 2 + 4 + 1
    got = {r["file"]: r for r in ranged.whole_files(df).collect()}
    assert {name: r["length"] for name, r in got.items()} == sizes
    assert got.pop("large")["error"] == "too large"
    assert all(bytes(r["content"]) == bytes([len(r["content"]) % 251]) * r["length"] for r in got.values())
    some = df.filter("file IN ('small007', 'small049', 'wide') AND start < 2000")
    assert sorted((r["file"], r["part"], len(r["data"])) for r in some.collect()) == [("small007", 0, 7), ("small049", 0, 49), ("wide", 0, 1000), ("wide", 1, 1000)]


def test_bundles_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "TOGETHER", 1000)
    monkeypatch.setattr(ranged, "BATCH", 300)
    for k in range(40):
        (tmp_path / f"f{k:02d}").write_bytes(b"x" * 90)
    reader = ranged.RangedReader({"path": tmp_path.as_uri()})
    planned = reader.partitions()
    assert [len(p.ranges) for p in planned] == [11, 11, 11, 7]
    assert [b.num_rows for p in planned for b in reader.read(p)] == [4, 4, 3] * 3 + [4, 3]


def test_a_listing_reads_nothing(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
    reader = ranged.RangedReader({"path": tmp_path.as_uri(), "least": "2", "data": "false"})
    planned = reader.partitions()
    for p in tmp_path.iterdir():
        p.unlink()
    (rows,) = [b.to_pylist() for p in planned for b in reader.read(p)]
    assert len(planned) == 1 and {(r["file"], r["length"]) for r in rows} == {(f"f{k}", k) for k in range(20)} and all(r["data"] is None for r in rows)


def test_blobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "ROLL", 300)
    rows = [(k, bytes([k % 251]) * (k % 40)) for k in range(200)] + [(7, None), (None, b"no id")]
    df = spark.createDataFrame(rows, "id long, data binary").repartition(3)
    index = ranged.write_blobs(df, f"file://{tmp_path}/blobs", f"{tmp_path}/index")
    assert index.select("file").distinct().count() > 5
    got = ranged.read_places(index, f"file://{tmp_path}/blobs").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["id"], bytes(r["data"])) for r in got), key=key) == sorted(((i, d or b"") for i, d in rows), key=key)
    some = ranged.read_places(index.filter("id IN (10, 15, 190)"), f"file://{tmp_path}/blobs").agg(F.sum("fetched")).first()[0]
    assert some <= 10 + 15 + 30 + 600
    with pytest.raises(Exception, match="ends before"):
        ranged.read_places(index.withColumn("length", F.col("length") + 1000), f"file://{tmp_path}/blobs").collect()
    assert ranged.read_places(index.limit(0), f"file://{tmp_path}/blobs").collect() == []


def shown(path):
    return sorted(p.name for p in Path(path).iterdir() if not p.name.endswith(".crc"))


def test_files_are_published_whole_or_not_at_all(spark, tmp_path):
    at = tmp_path / "out"
    rows = [(f"j{k}.pdf", b"x" * k, k) for k in range(30)]
    df = spark.createDataFrame(rows, "name string, data binary, length long").repartition(4)
    publish.publish(df, at.as_uri())
    assert shown(at) == sorted(r[0] for r in rows)
    listing = ranged.ranged(spark, at.as_uri(), parts=1).select(F.col("file").alias("name"), "length")
    jobs = spark.createDataFrame([("j3", 3), ("j4", 5), ("none", 1)], "job_id string, length long")
    assert [r["job_id"] for r in files.adopted(listing, jobs).collect()] == ["j3"]
    # one wrong length, or one name that leaves the folder, and nothing new shows
    for wrong in (("new-bad.pdf", b"abc", 4), ("../out.pdf", b"abc", 3)):
        more = spark.createDataFrame([(f"new{k}.pdf", b"y", 1) for k in range(20)] + [wrong], df.schema).repartition(5)
        with pytest.raises(Exception, match="bytes and not|no file's name"):
            publish.publish(more, at.as_uri())
        assert [x for x in shown(at) if not x.endswith(".partial")] == sorted(r[0] for r in rows)


def test_a_failed_attempt_leaves_nothing(tmp_path):
    """A task fails after its first file, and its second attempt is committed."""
    from pyspark.sql import Row

    writer = publish.PublishedWriter((tmp_path / "o").as_uri())

    def broken():
        yield Row(name="a", data=b"1")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert len(shown(tmp_path / "o")) == 1
    writer.commit([writer.write(iter([Row(name="a", data=b"1"), Row(name="b", data=None)])), None])
    assert shown(tmp_path / "o") == ["a", "b"]


def test_attempts_and_waits():
    waits, calls = [], []

    def post(key, body, n):
        calls.append(n)
        if n == 1:
            raise OSError("refused connection")
        return n == 3

    assert publish.attempted(post, "k", "b", waits.append) == {"attempts": 3, "delays_ms": [500, 2000], "delivered": True}
    assert waits == [500, 2000] and calls == [1, 2, 3]
    out = publish.attempted(lambda *_: False, "k", "b", waits.append)
    assert out == {"attempts": 4, "delays_ms": [500, 2000, 4500], "delivered": False, "error": "refused"}


def test_a_batch_that_is_played_twice_shows_once(tmp_path):
    from pyspark.sql import Row

    make = lambda: publish.CallbackWriter((tmp_path / "c").as_uri(), lambda *_: True, lambda ms: None)
    rows = [[Row(key=str(k), body="{}") for k in range(j, 10, 2)] for j in range(2)]
    for _ in range(2):  # the second as after a restart
        writer = make()
        writer.write(iter(rows[0]))  # an attempt that is lost
        writer.commit([writer.write(iter(r)) for r in rows], 4)
    broken = make()
    broken.abort([broken.write(iter(rows[0]))], 5)
    lines = [json.loads(x) for p in (tmp_path / "c").glob("*.jsonl") for x in p.read_text().splitlines()]
    assert sorted(x["key"] for x in lines) == [str(k) for k in range(10)]
    assert not list((tmp_path / "c").glob("*.partial"))


def test_callbacks_of_a_stream(spark, tmp_path):
    publish.register_callbacks(spark, "test_callbacks", lambda key, body, n: n >= int(key) % 3, wait=lambda ms: None)
    for k in range(3):
        spark.createDataFrame([(str(10 * k + j), "{}") for j in range(4)], "key string, body string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, body string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.writeStream.format("test_callbacks").option("path", (tmp_path / "out").as_uri()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = publish.callback_results(spark, (tmp_path / "out").as_uri()).collect()
    assert sorted((r["key"], r["attempts"], r["delivered"]) for r in got) == sorted((str(10 * k + j), max(1, (10 * k + j) % 3), True) for k in range(3) for j in range(4))
