import hashlib
import re
import time

from pagewright.llm import scratch, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def slow(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    None, "", "nothing", "password: token: abcdef", "Password='hunter2' x", "é中😀 api_key = \"ABCdef123\" after", "apikey:abcde", "secret=secret=longenough=",
    "AKIA" + "A" * 15, "AKIA" + "B7" * 8, "xAKIAAKIA" + "Z" * 20, "ff" * 12, "g" + "0a" * 30 + "G", "token=" + "ab12" * 8, "toKEN : abc\npasswd\"='q1w2e3r4'", "ſecret=abcdefgh",
    "password:\tabcdefgh", "a" * 40_000 + " token=abcdefgh " + "b" * 30, "AKIA" + "0" * 30 + "token:zzzzzz",
]


def test_spans_match_plain_matching(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "token=abcdef", "x"), (0, "token=abcdef", "x"), (None, "token=abcdef", "x")]
    df = spark.createDataFrame(rows, "path long, text string, blob string").repartition(4)
    found, ledger = secrets.scan_versions(df)
    got = sorted(((r["path"], r["blob"], [tuple(s) for s in r["spans"]]) for r in found.collect()), key=str)
    want = sorted(((p, hashlib.sha256((t or "").encode()).hexdigest(), slow(t or "")) for p, t, _ in rows), key=str)
    assert got == want
    assert ledger.count() == len({w[1] for w in want})


def test_only_unseen_blobs_and_versions_are_scanned(spark):
    one = spark.createDataFrame([(1, "token=abcdef"), (2, "plain")], "path long, text string")
    _, ledger = secrets.scan_versions(one)
    # a marked ledger shows that its pairs are not scanned again
    marked = ledger.withColumn("spans", secrets.F.slice("spans", 1, 0))
    two = spark.createDataFrame([(1, "token=abcdef"), (3, "token=ghijkl")], "path long, text string")
    found, ledger2 = secrets.scan_versions(two, ledger=marked)
    assert {r["path"]: len(r["spans"]) for r in found.collect()} == {1: 0, 3: 1}
    assert ledger2.count() == 3
    found, ledger3 = secrets.scan_versions(two, ledger=marked, version="3")
    assert {r["path"]: len(r["spans"]) for r in found.collect()} == {1: 1, 3: 1}
    assert ledger3.count() == 4


def test_redaction(spark):
    texts = [*TEXTS, "x" * 1023 + " token=abcdefgh", "é" * 1024 + "AKIA" + "Q" * 20, "token=abcdefgh" * 200, "token=" + "0" * 3000 + "." + "ab" * 700 + " " + "cd" * 12 + " AKIA" + "9" * 20, ("word " * 300 + "ff" * 13 + "\n") * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["clean"] for r in secrets.without_secrets(df).select("row.doc_id", "clean").collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, _, z, kind in slow(t or ""):
            if a >= at:
                out += t[at:a] + f"[{kind}]"
            at = max(at, z)
        assert got[i] == (out + t[at:] if out else None), i


def test_many_hits_in_one_text_cost_their_number(spark):
    """100,000 of them, in a text of 3.3 million characters."""
    text = "\n".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(100_000))
    df = spark.createDataFrame([(1, text, "c")], "doc_id long, text string, cuts string")
    began = time.perf_counter()
    found, _ = secrets.scan_versions(df, "doc_id")
    (row,) = found.collect()
    assert [tuple(s) for s in row["spans"]] == slow(text)
    (row,) = secrets.without_secrets(df).collect()
    assert row["clean"] == "\n".join(["[hex]"] * 100_000) and row["row"]["cuts"] == "c"
    assert time.perf_counter() - began < 60


def test_stored_ledger(spark):
    store = f"{scratch.root(spark)}/ledger"
    rows = [(1, "token=abcdef"), (2, "token=abcdef"), (3, "plain"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "path long, text string")
    first, _ = secrets.scan_versions(df, store=store)
    want = sorted(map(str, first.collect()))
    assert spark.read.parquet(store).count() == 3
    again, whole = secrets.scan_versions(df, store=store)
    assert sorted(map(str, again.collect())) == want and whole.count() == 3
    assert spark.read.parquet(store).count() == 3  # nothing was scanned
    more, _ = secrets.scan_versions(df.union(spark.createDataFrame([(5, "AKIA" + "A" * 20)], df.schema)), store=store)
    assert {r["path"]: len(r["spans"]) for r in more.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert spark.read.parquet(store).count() == 4


def test_no_rows(spark):
    found, ledger = secrets.scan_versions(spark.createDataFrame([], "path long, text string"))
    assert found.count() == 0 == ledger.count()
