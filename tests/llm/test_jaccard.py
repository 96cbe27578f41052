import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from pagewright.llm import jaccard, similar
from pagewright.llm.jaccard import band, bit_sketches, differ, jaccard_groups, partners, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) of all pairs compared, and how many are similar but unlike."""
    sets, up, linked = [shingles(t) for _, t in rows], list(range(len(rows))), 0

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
                linked += sets[i] != sets[j]
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr), linked


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        at = r.randrange(len(w) + 1)
        kind = r.random()
        w[at : at + (kind < 0.6)] = [f"e{r.randrange(10**6)}"] if kind < 0.8 else []
    return w


def corpus(seed):
    r = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(40)]
    for k in range(25):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 6, 8, 9, 12, 20, 40, 70, 150, 230, 400]))]
        for _ in range(r.randint(1, 8)):
            w = edited(r, base, r.randint(0, max(1, len(base) // 20)))
            if r.random() < 0.3:
                w = passage + w
            text = " ".join(w)
            rows.append(text.upper() if r.random() < 0.1 else text)
    r.shuffle(rows)
    rows = list(enumerate(rows, 100))
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, "a b c d e"), (8, "A b c d e"), (None, "one two"), (None, rows[0][1]), (rows[3][0], rows[9][1]), (4, "one two"), (9, "x\x0by z\x1ct u v w")]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_link_of_a_corpus(spark, seed, monkeypatch):
    """Small blocks, so that words lie in several and some are crowded."""
    monkeypatch.setattr(similar, "BLOCK", 2 if seed == 1 else 64)
    monkeypatch.setattr(jaccard, "CROWD", 1)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, words string, id int")
    want, linked = brute(rows)
    assert linked > 10
    assert sorted(map(tuple, jaccard_groups(df).collect()), key=repr) == want


def test_no_rows_and_lone_rows(spark):
    kind = "doc_id long, text string"
    assert jaccard_groups(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, None), (2, "alone"), (None, "")]
    assert sorted(map(tuple, jaccard_groups(spark.createDataFrame(rows, kind)).collect()), key=repr) == brute(rows)[0]


def test_words_of_all_similar_sets_meet():
    """The promise of the sketches, at the limit of similarity and of each band."""
    r = np.random.default_rng(4)
    some = lambda k: r.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2)
    limits = 0
    for n in [*range(1, 70), 199, 224, 225, 230, 280, 896, 900, 1100, 4000]:
        for _ in range(6):
            m = int(r.integers(n, partners(n) + 1))
            common = next(c for c in range(n + 1) if 9 * c >= 4 * (n + m)) if 9 * n >= 4 * (n + m) else None
            if common is None:
                continue
            core = some(common)
            a, b = (np.unique(np.concatenate([core, some(k - common)])) for k in (n, m))
            assert len(a) == n and len(b) == m and (len(np.setxor1d(a, b)) <= min(differ(n), differ(m)))
            limits += n != m
            if n == m == common:
                continue
            for more in (0, 1):
                assert len(np.intersect1d(words_of(a, more), words_of(b, more))) >= 1 + more
            sketch = [bit_sketches(x, np.zeros(len(x), np.int64), 1) for x in (a, b)]
            assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= len(np.setxor1d(a, b))
    assert limits > 100
    assert all(1 << band(n) > differ(n) + 1 for n in range(4, 100000))


def test_a_large_group_costs_its_size(spark, monkeypatch):
    """Near copies of one text: what is compared beyond the stars doesn't grow with their square."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(r, base, 1))) for k in range(700)]
    seen = []
    whole = jaccard._verified

    def counted(keyed, distinct, pairs, *more):
        seen.append(pairs.count())
        return whole(keyed, distinct, pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    out = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0}
    assert len(seen) == 2 and seen[0] < 40 * len(rows) and seen[1] == 0


def test_sets_at_the_limit_make_no_square_of_pairs(spark, monkeypatch):
    """Near copies that link with each other, but not with those which the stars meet: the first ones, of more edits."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    cuts = [set(r.sample(range(200), 7 if k < 20 else 2)) for k in range(300)]
    rows = [(k, " ".join(f"e{k}_{j}" if j in cut else w for j, w in enumerate(base))) for k, cut in enumerate(cuts)]
    monkeypatch.setattr(jaccard, "FEW", 0, raising=False)  # as many rounds as join something
    made, whole = {}, jaccard.materialize

    def counted(df, name):
        if name == "jaccard_distinct":
            df = df.withColumn("id", F.row_number().over(Window.orderBy("low")).cast("long"))
        out = whole(df, name)
        if df.columns in (["a", "b"], ["x", "y"]):
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    want, linked = brute(rows)
    assert linked > 10 * len(rows)
    assert sorted(map(tuple, jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == want
    assert {name: n for name, n in made.items() if n > 8 * len(rows)} == {}


def test_long_texts_that_only_share_a_passage_do_not_meet(spark, monkeypatch):
    """Their words meet, their sketches tell them apart; those that are similar link, also where their sketches have unlike widths."""
    r = random.Random(3)
    passage, made, whole = [f"p{k}" for k in range(800)], {}, jaccard.materialize
    rows = [(k, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(1700)])) for k in range(24)]
    base = [f"b{k}" for k in range(3300)]
    rows += [(100 + k, " ".join(base[: 2900 + 100 * k])) for k in range(5)]

    def counted(df, name):
        out = whole(df, name)
        if df.columns in (["a", "b"], ["x", "y"]):
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    want, linked = brute(rows)
    assert linked == 10
    assert sorted(map(tuple, jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == want
    assert made["jaccard_star"] and {name: n for name, n in made.items() if n > 10} == {}


def test_sets_that_may_be_similar_lie_in_one_block(spark, monkeypatch):
    """Families just below the limit, which no link joins: few blocks travel to meet another."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    r = random.Random(8)
    rows = []
    for f in range(60):
        base = [f"f{f}_{k}" for k in range(1200)]
        rows += [" ".join(w if j % 35 or not v else f"e{f}_{v}_{j}" for j, w in enumerate(base)) for v in range(4)]
    r.shuffle(rows)
    met, whole = [], jaccard.compare

    def counted(pairs, blocks, near):
        met.append(0 if pairs is None else pairs.filter("x != y").count())
        return whole(pairs, blocks, near)

    monkeypatch.setattr(jaccard, "compare", counted)
    want, linked = brute(list(enumerate(rows)))
    assert not linked
    assert sorted(map(tuple, jaccard_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()), key=repr) == want
    assert met and sum(met) < 30
