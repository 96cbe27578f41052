"""Groups of similar texts against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import similar


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def slow_groups(rows):
    sets, up = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                up[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[root(k)] = min(d, low.get(root(k), d))
    return {d: low[root(k)] for k, (d, _) in enumerate(rows)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"e{rng.random()}"], [words[k], "more"]])
    return words


def texts():
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 3000}"
    common = [f"c{i}" for i in range(30)]
    made = [None, "", " \t", "a b c", "A b c", "a b c d", "one two three four five six"]
    for _ in range(60):  # edits around the limit, chains, and a line that many share
        base = [word() for _ in range(rng.choice([6, 9, 12, 20, 40, 120, 400]))] + (common if rng.random() < 0.5 else [])
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            made.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))))
            if rng.random() < 0.3:
                base = made[-1].split()
    made += [f"{x} {y} {x} {y} {x} {y}" for x in "pqrs" for y in "pqrs"]  # six words, two shingles
    base = [word() for _ in range(50)]
    made += [" ".join(edited(rng, base, rng.randint(1, 3))) for _ in range(80)]  # one large group
    rng.shuffle(made)
    return list(enumerate(made))


def grouped(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).select(F.struct("doc_id").alias("key"), "text")
    return {r["doc_id"]: r["component"] for r in similar.similar_groups(df).select("key.doc_id", F.col("component_id.doc_id").alias("component")).collect()}


def recall(got, want):
    """Of pairs of neighbours in a wanted group, the share that is in one group; no group may hold more than a wanted one."""
    whole = {}
    for d, c in got.items():
        assert whole.setdefault(c, want[d]) == want[d]
    groups = {}
    for d, c in sorted(want.items()):
        groups.setdefault(c, []).append(d)
    pairs = [(a, b) for g in groups.values() for a, b in zip(g, g[1:])]
    return sum(got[a] == got[b] for a, b in pairs) / len(pairs)


def test_groups_against_brute_force(spark):
    rows = texts()
    got, want = grouped(spark, rows), slow_groups(rows)
    assert recall(got, want) >= 0.97
    assert 50 < len(set(want.values())) < len(rows) - 100


def test_recall_on_documents(spark):
    """Links between different texts of sf0.01 that share 0.8 or more, by brute force over all pairs."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = grouped(spark, docs)
    sets = [(d, slow_set(t)) for d, t in docs]
    true = found = 0
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a != b and a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                true, found = true + 1, found + (got[d] == got[e])
            elif a == b:
                assert got[d] == got[e]
    assert true > 5 and found / true >= 0.97
    assert recall(got, slow_groups(docs)) >= 0.97


def test_large_families_take_several_blocks(spark):
    """One family of many blocks, of which some sets are similar, in chains, and others are only close."""
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(400)}" for _ in range(90)], []
    for k in range(400):
        rows.append((k, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))))
    got, want = grouped(spark, rows), slow_groups(rows)
    assert recall(got, want) >= 0.97 and len(set(want.values())) > 5


def test_compared_blocks_match_plain_sets():
    rng = np.random.default_rng(1)
    for sizes in ((5, 7), (1, 1), (40, 64)):
        sets = [[np.unique(rng.integers(0, 60, rng.integers(0, 80), dtype=np.uint64)) for _ in range(n)] for n in sizes]
        x, y = (similar.Block(list(range(k, k + len(s))), np.zeros((len(s), 2), np.uint64).tobytes(), [len(m) for m in s], np.concatenate(s).tobytes()) for k, s in ((0, sets[0]), (100, sets[1])))
        every = [(i, m) for i, m in enumerate(sets[0])] + [(100 + i, m) for i, m in enumerate(sets[1])]
        for p, q, ids in ((x, x, range(0, 100)), (x, y, range(0, 200))):
            a, b = similar.compared(p, q)
            up = {i: i for i, _ in every}

            def root(i):
                while up[i] != i:
                    i = up[i]
                return i

            got = []
            for i, j in zip(a.tolist(), b.tolist()):
                up[root(i)] = root(j)
                got.append((i, j))
            inside = [(i, m) for i, m in every if i in ids]
            for n, (i, m) in enumerate(inside):
                for j, o in inside[n + 1 :]:
                    alike = 9 * len(np.intersect1d(m, o)) >= 4 * (len(m) + len(o))
                    if (p is q or (i < 100) != (j < 100)) and alike:
                        assert root(i) == root(j)
            by = dict(every)
            assert all(9 * len(np.intersect1d(by[i], by[j])) >= 4 * (len(by[i]) + len(by[j])) for i, j in got)


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as cp

    rows = texts()
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, df, "").collect()) == sorted(set(grouped(spark, rows).values()))


def test_no_rows(spark):
    assert grouped(spark, []) == {}


def test_settings_keep_the_recall():
    p = 0.1515
    for n in (1, 1000, 10**6, 10**9, 4 * 10**10):
        s = similar.settings(n)
        meets = (1 - p) ** s["front"] + s["front"] * p * (1 - p) ** (s["front"] - 1)
        assert (1 - meets) ** len(s["turns"]) <= 0.0051 and n * (s["front"] + 1) / 2 ** s["front"] <= 16
