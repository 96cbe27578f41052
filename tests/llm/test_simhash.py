import numpy as np
import xxhash

from pagewright.llm import simhash


def slow_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    width = min(width, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, most):
    """rows: (doc_id, fp); smallest doc_id reachable for each row."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                up[root(a)] = root(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    return sorted(((d, f, low.get(root(f))) for d, f in rows), key=str)


def test_fingerprint_matches_a_plain_one():
    for text in ("", " \t\n", "One", "two words", "A b c D e f g", "Ünï Ñ x\x0by\x0cz " * 50, "same same same same same", "\x1c\x85 a\x1cb c d"):
        for width in (3, 5):
            assert simhash.fingerprint(text.encode(), width) == slow_fingerprint(text, width), text


def test_tree_finds_every_link():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    close = [seeds]
    for _ in range(6):
        close.append(seeds ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    chain = np.cumsum(rng.integers(0, 7, 900)).astype(np.uint64)
    fps = np.unique(np.concatenate([*close, chain]))
    rows = np.stack([fps, np.zeros_like(fps), np.arange(len(fps), dtype=np.uint64)], axis=1)
    mine, rest = rows[::2], rows[1::2]
    for most in (0, 2, 5):
        a, b = (np.concatenate(x) for x in zip(simhash.links(mine, None, most), simhash.links(rest, None, most), simhash.links(mine, rest, most)))
        forest = simhash.Forest(len(fps))
        for i, j in zip(a.tolist(), b.tolist()):
            forest.join(i, j)
        roots = forest.flat()
        want = {f: c for _, f, c in slow_components([(int(f), int(f)) for f in fps], most)}
        assert [int(fps[r]) for r in roots] == [want[int(f)] for f in fps]


def test_components_match_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base.replace(f"w{i * 7}", f"x{i}", 1), "en") for i in range(40)]
    rows += [(100 + i, base, "en") for i in range(30)] + [(None, base, "en"), (200, None, "a"), (201, "", "b"), (201, "", "b"), (None, " ", "c")]
    rows += [(300 + i, f"quite another text number {i} " * (i + 1), "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()), key=str)
    want = slow_components([(d, slow_fingerprint(t or "", 3)) for d, t, _ in rows], 2)
    assert got == want
    assert len({c for *_, c in want}) < len(rows) - 60


def test_chain_over_many_ranges(spark):
    fps = [(1 << i) - 1 for i in range(64)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").selectExpr("fp", "0L AS more", "fp AS node")
    roots = simhash.components(simhash.link_forest(df, 1))
    rows = roots.collect()
    assert len(rows) == 63 and len({r["root"] for r in rows}) == 1


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_turns_keep_distances():
    x = np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64)
    for k in range(5):
        t = simhash.Turn(k)
        assert (np.bitwise_count(t.turned(x) ^ t.turned(x[::-1])) == np.bitwise_count(x ^ x[::-1])).all()
    assert (simhash.Turn(0).turned(x) == x).all()


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(9)
    for n, m in ((50, 30), (200, 180), (60, 400)):
        edges = [(int(a), int(b)) for a, b in rng.integers(-n, n, (m, 2))]
        edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(100)]
        up = {x: x for e in edges for x in e}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root(x) for x in up if root(x) != x}


def test_ranges_of_many_turns_stay_small(spark, monkeypatch):
    """A task's tree doesn't grow with the turns, nor with rows of one fingerprint; the links are the same."""
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**64, 500, dtype=np.uint64)
    fps = np.concatenate([seeds, seeds ^ np.uint64(1 << 17), np.full(600, seeds[0])]).view(np.int64)
    rows = [(f, int(m), i) for i, (f, m) in enumerate(zip(fps.tolist(), rng.integers(0, 2**62, len(fps)) & 3))]
    df = spark.createDataFrame(rows, "fp long, more long, node long")
    whole = {r["node"]: r["root"] for r in simhash.components(simhash.link_forest(df, 5)).collect()}
    assert len(whole) > 900
    sizes, blocks = [], simhash._blocks

    def counted(*a):
        made = blocks(*a)
        sizes.extend(r["n"] for r in made.groupBy("part").agg(simhash.F.sum(simhash.F.length("fps") / 24).alias("n")).collect())
        return made

    monkeypatch.setattr(simhash, "_blocks", counted)
    monkeypatch.setattr(simhash, "OWN", 200)
    monkeypatch.setattr(simhash, "RANGES", 2)
    turns = range(6)
    assert [len(t) for t, _ in simhash.batches_of(len(rows), turns, 4)] == [1] * 6
    many = {r["node"]: r["root"] for r in simhash.components(simhash.link_forest(df, 5, turns)).collect()}
    assert many == whole
    assert sum(sizes) == 6 * len(rows) and max(sizes) <= 3 * 200


def test_batches_of_turns():
    for n, turns in ((10**5, 14), (2 * 10**9, 149), (4 * 10**10, 302), (0, 1)):
        parts = simhash.batches_of(n, range(turns), 200)
        assert [t for b, _ in parts for t in b] == list(range(turns))
        assert all(n * len(b) <= k * simhash.OWN and (len(b) == 1 or k <= simhash.RANGES) for b, k in parts)


def crowd_rows(n, groups):
    """Random fingerprints of 128 bits, and groups of close ones; the third column numbers them."""
    rng = np.random.default_rng(5)
    made = [rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)]
    for size in groups:
        m = np.repeat(rng.integers(0, 1 << 64, (1, 2), dtype=np.uint64), size, 0)
        for row in m:
            for b in rng.integers(0, 128, rng.integers(0, 14)).tolist():
                row[b // 64] ^= np.uint64(1 << b % 64)
        made.append(m)
    made = rng.permutation(np.concatenate(made))
    return np.concatenate([made, np.arange(len(made), dtype=np.uint64)[:, None]], axis=1)


def test_leading_bits_bring_together_each_pair_once():
    lead = np.uint64(((1 << 10) - 1) << 54)
    own, guests = crowd_rows(1000, [500, 40, 5]), crowd_rows(50, [200])
    own[:300, 0] = own[0, 0]  # one crowded bucket of all sorts of other halves
    guests[:80] = own[:80]
    for other in (None, guests):
        for near in (0, 1):
            ta = simhash.Tree(own)
            tb = ta if other is None else simhash.Tree(other)
            labels = ta.rows[:, 2], tb.rows[:, 2]
            got = [(x, y) for a, b in simhash.lead_pairs(ta, tb, 28, lambda: labels, lead, near) for x, y in zip(labels[0][a].tolist(), labels[1][b].tolist())]
            x, y = own, own if other is None else other
            apart = x[:, None, 0] ^ y[None, :, 0]
            close = np.bitwise_count(apart).astype(int) + np.bitwise_count(x[:, None, 1] ^ y[None, :, 1]) <= 28
            close &= (np.bitwise_count(apart & lead) <= near) & (x[:, None, 2] != y[None, :, 2])
            want = [(i, j) for i, j in np.argwhere(close).tolist() if other is not None or i < j]
            assert sorted(tuple(sorted(p)) if other is None else p for p in got) == want and len(want) > 100


def test_work_of_a_turn_is_about_the_pairs_that_agree_in_front(monkeypatch):
    """Of 20000 unlike fingerprints each meets about 16 others; nodes that share too little came to hundreds."""
    count, compared, largest = np.bitwise_count, 0, 0

    def counted(x):
        nonlocal compared, largest
        compared, largest = compared + x.size, max(largest, x.size)
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    rows = crowd_rows(20000, [])
    simhash.links(rows, None, 28, np.uint64(((1 << 15) - 1) << 49), 1)
    assert compared < 32 * len(rows) and largest < 1 << 18
