import math

import numpy as np

from pagewright.llm import vafile


def slow(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    return sorted(tuple(r) for r in vafile.top_k(df, **more).collect())


def test_matches_brute_force(spark, monkeypatch):
    for name, n in (("SLAB", 64), ("GROUP", 5), ("UNITS", 9), ("SCAN", 3)):
        monkeypatch.setattr(vafile, name, n)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 3, 12).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # one common vector: ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf"), 1.0]), (None, [1.0] * 12), (2200, []), (2250, [0.5, -2.0]), (50, rows[3][1]), (51, rows[4][1])]
    assert run(spark, rows) == slow(rows)


def test_wide_cells_and_few_rows(spark):
    rows = [(i * 50, [(-1.0) ** i * 10.0**i, 1.0, 0.001]) for i in range(6)]
    assert run(spark, rows) == slow(rows)
    assert run(spark, [(0, [1.0, 2.0])]) == [] == run(spark, [])
    assert run(spark, [(0, [1.0]), (1, [0.0])]) == [(0, 1, 1, 0)]


def test_values_beyond_a_long(spark):
    """Components and scores stop at the ends of a long; ties there go to smaller ids."""
    low, high = -(2**63), 2**63 - 1
    held = lambda x: min(max(x, low), high)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 3) * 10.0 ** int(rng.integers(-2, 20))).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200, [1e30, 1.0, 0.0]), (201, [-1e30, 1.0, 0.0]), (250, [1e30, -1e30, 0.5]), (251, [3e38, 3e38, 3e38])]
    whole = [(i, [held(math.floor(256 * float(x))) for x in v]) for i, v in rows]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scored = sorted((-held(sum(x * y for x, y in zip(a, b))), c) for c, b in whole if c != q)[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert run(spark, rows) == sorted(want)
