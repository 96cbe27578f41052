import re
from itertools import permutations

import duckdb
import pytest

from pagewright.llm.audit import OP13_SQL, interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Runs every order filter by filter over the documents that are left."""
    fails = []
    for n, (i, text, source) in enumerate(docs):
        text = text or ""
        w = WORD.findall(text)
        a, b, c = len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)
        d = bool(re.search("[#$%&*|]", text))
        e = any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in docs)
        fails.append(({f for f, x in zip("ABCDE", (a, b, c, d, e)) if x}, source or "", any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out, removed = {}, {}
    for part in {f[1] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[1] == part]
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[0]]
                left = [f for f in left if c not in f[0]]
                lost = [f for f in fails if f[1] == part and c in f[0] and f[0] & set(order[:k])]
                only = [f for f in fails if f[1] == part and f[0] == {c}]
                out[part, order, k + 1] = [len(left), len(gone), len(lost), len(only), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed[part, c] = removed.get((part, c), 0) + len(gone)
    return {(p, o, k): (*v, removed[p, o[k - 1]]) for (p, o, k), v in out.items()}


LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (1, LONG, None), (None, LONG, "a"), (3, None, "a"), (4, "", ""), (None, None, "b"), (5, LONG.upper(), "a"), (6, LONG + " #", "a"),
    (7, "x " * 80, "b"), (8, ("x " * 80) + "|", "b"), (9, "É" * 40, None), (10, "a b c\x1cd\x0be", "a"), (11, LONG + " 50%\nA", "b"), (None, "no one else", "a"), (None, "no one else", "a"),
    (12, " ".join("AbC" for _ in range(70)), "c"), (13, " ".join(f"long{k}" for k in range(60000)), "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, None), (5, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1)]


def test_every_order_of_filters(spark):
    docs = spark.createDataFrame([(*d, "clash", 0) for d in DOCS], "doc_id long, text string, source string, digest string, fails int")
    labels = spark.createDataFrame([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    rows = interactions(docs, labels).collect()
    want = brute(DOCS, LABELS)
    assert len(rows) == len(want) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == want


@pytest.mark.parametrize("seen", [0, 1])
def test_sql_says_the_same(spark, seen, tmp_path):
    docs = spark.createDataFrame(DOCS[: seen * 99], "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}/*.parquet'")
    got = interactions(docs, labels)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP13_SQL})").fetchall())
