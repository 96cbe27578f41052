import gzip
import hashlib
from pathlib import Path

import pytest

from pagewright.llm import scratch, warc

LONG = "<p>ñ</p>" * 40
ROWS = [(i, f"http://h{i % 5}.example.com:8080/p/{i}?q={i}", LONG + str(i % 7) * (i % 3)) for i in range(300)]
ROWS += [(1000, None, LONG), (1001, "http://[bad", "short"), (1002, "", "short"), (1003, "HTTP://Ex.Org/a\tb\nü", None), (1004, "x" * 3000, "y" * 400_000), (None, None, LONG), (None, "http://n", "only here " * 30), (5, "http://h0.example.com:8080/p/5?q=5", ROWS[5][2])]


def want(rows):
    low = {}
    for p, _, h in rows:
        if p is not None:
            low[h] = min(p, low.get(h, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and h in low and low[h] != p
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low[h] if again else None))
    return sorted(out, key=str)


def test_pages_come_back_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 8)
    df = spark.createDataFrame([(*r, 3) for r in ROWS], "page_id long, url string, html string, digest int").repartition(4)
    folder = scratch.root(spark)
    records = warc.write_archives(df, f"{folder}/archives")
    index = warc.write_index(records, f"{folder}/index")
    got = warc.read_captures(df, index, f"{folder}/archives").drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == want(ROWS)
    # archives are readable as one stream of gzip members
    n = sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in Path(folder.removeprefix("file://"), "archives").iterdir())
    assert n == len(ROWS)
    # single look-ups
    reader = index.reader()
    for page, url, _ in ROWS[:40]:
        (capture, *_) = reader.find(warc.surt(url), page)
        assert reader.read(f"{folder}/archives", capture)[0]["WARC-Record-ID"] == f"<urn:pagewright:page:{page}>"
    assert reader.find("zzz)/", 1) == [] == reader.find("", 0)


@pytest.mark.parametrize("url, key", [("http://www.Example.com/a?b=1", "com,example,www)/a?b=1"), ("https://x.org:443", "org,x)/"), ("http://x.org:81/é", "org,x:81)/%C3%A9"), (None, "-")])
def test_keys(url, key):
    assert warc.surt(url) == key


DIRTY = ["http://a.de/x ", " http://a.de/x", "http://a.de/x\ny", "http://a.de\t/x", "http://MÜNCHEN.de/", "http://münÉ.De/É", "http://[bad", "http://a.de:port/", "http://a.de:99999999/", "%zz", "http://a.de/%20x", "\u3000http://a.de", "//", "http://ＡＢ.de/", "\r\n", "http://u:p@A.de/"]


@pytest.mark.parametrize("url", DIRTY)
def test_raw_and_quoted_urls_have_one_key(url):
    assert warc.surt(url) == warc.surt(warc.quote(url, safe=warc._SAFE))


def test_copies_of_pages_with_dirty_urls(spark):
    rows = [(2 * k + n, url if n == 0 else f"http://copy/{k}", f"<p>{k}</p>" * 40) for k, url in enumerate(DIRTY) for n in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch.root(spark)
    index = warc.write_index(warc.write_archives(df, f"{folder}/a"), f"{folder}/i")
    got = warc.read_captures(df, index, f"{folder}/a").drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows)
    assert sum(r["record_type"] == "revisit" for r in got) == len(DIRTY)


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch.root(spark)
    index = warc.write_index(warc.write_archives(df, f"{folder}/a"), f"{folder}/i")
    assert warc.read_captures(df, index, f"{folder}/a").count() == 0


def test_one_page_id_and_url_under_several_payloads(spark):
    a, b, c = ("<p>%s</p>" % x * 30 for x in "abc")
    rows = [(1, "http://one", a), (1, "http://one", b), (1, "http://one", b), (2, "http://two", a), (3, "http://one", b), (2, "http://two", c), (7, "http://x", c), (1, "http://other", a), (4, None, a), (9, "http://one", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch.root(spark)
    index = warc.write_index(warc.write_archives(df, f"{folder}/a"), f"{folder}/i")
    got = warc.read_captures(df, index, f"{folder}/a").drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows)
