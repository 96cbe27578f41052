import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pagewright.llm.periodic import LEAST, blocks, longest_previous, numbered, op11_periodic_runs, periodic_runs, Ranks, runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(w, least=LEAST):
    """Every stretch and every period, from the definition."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def cases():
    r = random.Random(5)
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 13, list("ab") * 6, list("ab") * 30, ["x", *"abc" * 20, "y"] * 3)
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield from (list(fib[-1]), list(fib[-1] + "c" + fib[-2]), list((fib[7] + "z") * 6), list(fib[9][::-1]))
    for size in (30, 80, 200):
        for letters in (1, 2, 3, 5):
            for _ in range(6):
                yield [r.choice("abcde"[:letters]) for _ in range(size)]
    for _ in range(60):  # texts made of copies of themselves, with slips
        w = [r.choice("abcdefgh") for _ in range(r.randint(2, 30))]
        while len(w) < 250:
            if r.random() < 0.6:
                p = r.randint(1, len(w))
                w += [w[len(w) - p] for _ in range(1)] if r.random() < 0.2 else (w[-p:] * r.randint(1, 4))[: r.randint(1, 90)]
            else:
                w.append(r.choice("abcdefghij"))
        yield w


def test_all_runs_of_many_texts():
    seen = 0
    for w in cases():
        want = brute(w)
        assert runs(numbered([x.encode() for x in w])) == want, w
        seen += len(want)
    assert seen > 500


def test_longest_previous_factors():
    for w in list(cases())[8:40]:
        ids = numbered([x.encode() for x in w])
        length, place = longest_previous(Ranks(ids))
        for i in range(len(w)):
            best = max((next((k for k in range(len(w) - i) if w[j + k] != w[i + k]), len(w) - i) for j in range(i)), default=0)
            assert length[i] == best and (best == 0 or (place[i] < i and w[place[i] : place[i] + best] == w[i : i + best]))
        assert sum(s for _, s, _ in blocks(length, place)) == len(w)


def test_a_long_text_in_little_time():
    r = np.random.default_rng(3)
    part = [b"w%d" % k for k in r.integers(0, 50, 30000)]
    found = runs(numbered(part * 6 + part[:11]))
    assert (0, 180011, 30000) in found


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a " * 40), (4, "a " * 40), (None, "b\x0bb " * 30), (5, "ü é ü é " * 9 + "x y"), (6, "one two"), (9, "A a " * 20), (12, "a b c d e f g " * 5 + "end"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, runs string")
    rows = periodic_runs(docs).collect()
    want = []
    for i, t in ODD:
        w = WORD.findall((t or "").encode())
        found = brute(w)
        drop = {k for s, e, q in found for k in range(s + q, e)}
        want.append((i, tuple((s, e - s, q) for s, e, q in found), b" ".join(x for k, x in enumerate(w) if k not in drop).decode()))
    got = [(r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["la", "le", "lu", "lo"]) + str(r.randint(0, 6)) for _ in range(r.randint(0, 90)))) for k in range(150)] + ODD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path, rows


def test_query_from_its_definition(spark, folder):
    got = op11_periodic_runs(spark, str(folder[0])).collect()
    want, changed = [], 0
    for i, t in folder[1]:
        w = WORD.findall((t or "").encode())
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], changed + 1
        found = brute(w)
        drop = {k for s, e, q in found for k in range(s + q, e)}
        s, e, q = min(found, key=lambda x: (x[0] - x[1], x[0], x[2])) if found else (None,) * 3
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(found), s, found and e - s or None, q, found and 1000 * (e - s) // q or None, sha("".join(f"{a},{b - a},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop))))
    assert changed > 5
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
