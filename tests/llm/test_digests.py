import hashlib
import re
import unicodedata
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from pagewright.llm import digests


def form(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"[ \t\n\x0b\f\r\x1c-\x1f\x85   ]+", " ", t).strip(" ")


def slow(rows):
    """What comes back for each row, by forms in place of fingerprints."""
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), signed(h(r[1]))))
    after = dict(zip(order, order[1:] + order[:1]))
    out = []
    for d, t in rows:
        t = t or ""
        nxt = after[d, t][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), form(t), form(e), float(form(t) == form(e)), float(form(t) == form(nxt))))
    return out


ROWS = [(i, f"Document number {i} in some words\n" * (i % 5 + 1)) for i in range(80)]
ROWS += [(100 + i, t) for i, t in enumerate(["", None, "a", "B", "ﬁne  Straße", "FINE strasse", " fine STRASSE\n", "é", "é", "Éa", "中文字", "😀😀 x", "x" * 100_000, "same text", "SAME\ttext", "same text"])]
ROWS += [(7, "clashing id"), (7, "clashing id"), (7, ROWS[7][1]), (None, "no id"), (None, None), (500, "twin twin"), (499, "twin twin"), (498, "twin twin")]


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = digests.document_digests(df, **more).collect()
    want = slow(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    forms, prints = defaultdict(set), defaultdict(set)
    for g, w in zip(got, want):
        for a, b in ((g[3], w[3]), (g[4], w[4])):
            forms[a].add(b)
            prints[b].add(a)
    assert all(len(x) == 1 for x in (*forms.values(), *prints.values()))
    return got


def test_matches_brute_force(spark):
    got = check(spark, ROWS)
    wide = lambda t: f"{xxhash.xxh64_intdigest(t, 42):016x}{xxhash.xxh64_intdigest(t, xxhash.xxh64_intdigest('wide', 42)):016x}"
    assert {r[3] for r in got} == {wide(form(t or "").encode()) for _, t in ROWS}


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    check(spark, ROWS, hashes=lambda c: (F.length(c).cast("long") % 7, F.lit(5).cast("long")))


def test_few_rows(spark):
    for rows in ([], [(1, "only one")], [(None, None)], [(1, "x"), (1, "x")]):
        check(spark, rows)
