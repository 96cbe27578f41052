"""Parts of uploads come back once and whole, however a body is cut."""

import random

import pytest

from pagewright.sources import uploads


@pytest.mark.parametrize("size", [7, 64, 501, 1 << 20])
def test_parts_for_every_range_size(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(uploads, "CHUNK", 16 if size < 100 else 1 << 20)
    r = random.Random(size)
    rows = [(f"d{k}.pdf", bytes(r.choice(b"ab\r\n-") for _ in range(r.choice([0, 1, 5, 60, 300])))) for k in range(40)] + [("none.pdf", None), ("dash.pdf", b"\r\n--" * 20)]
    df = spark.createDataFrame(rows, "filename string, data binary").repartition(3)
    bodies = uploads.write_bodies(df, f"file://{tmp_path}/b", f"{tmp_path}/list")
    got = uploads.read_uploads(bodies, f"file://{tmp_path}/b", size).collect()
    assert sorted((x["filename"], bytes(x["data"]), x["error"], x["name"]) for x in got) == sorted((n, d or b"", None, "file") for n, d in rows)


def test_a_body_that_breaks_off(spark, tmp_path):
    (tmp_path / "x").write_bytes(b'--B\r\nContent-Disposition: form-data; name="a"; filename="1"\r\n\r\none\r\n--B\r\nContent-Disposition: form-data; name="b"\r\n\r\ntwo')
    bodies = spark.createDataFrame([("x", (tmp_path / "x").stat().st_size)], "file string, length long")
    got = sorted((r["at"], r["filename"], r["data"] and bytes(r["data"]), r["error"]) for r in uploads.read_uploads(bodies, tmp_path.as_uri(), 50).collect())
    assert got == [(-2, "1", b"one", None), (got[1][0], None, None, "incomplete")]
    (tmp_path / "x").write_bytes(b"no boundary")
    with pytest.raises(Exception, match="doesn't begin"):
        uploads.read_uploads(bodies.limit(1).selectExpr("file", "11L AS length"), tmp_path.as_uri(), 50).collect()
