"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank and cut into leaves; a node keeps the bits that all its
members share (a mask and a pattern). Two nodes whose shared bits differ in more places than allowed
hold no linked pair, so whole groups of pairs are passed over without reading their members. What is close
by its fingerprint can be checked afterwards, text by text (similar.py).
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, materialize

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BLOCK = 1 << 16  # shingles hashed at a time, so that a very long text needs no more memory


def shingle_hashes(text: bytes, width: int):
    """Arrays of XXH64 of the shingles of UTF-8 text, in order, repeats included, _BLOCK at a time.

    A-Z are lowered, width words make a shingle. Fewer words make one shingle; no words give none.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    for at in range(0, len(starts), _BLOCK):
        cut = [joined[a:b] for a, b in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())]
        yield np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))


def majority(hashes) -> int:
    """64 bits: those that over half of all hashes have. hashes: arrays, one after the other."""
    counts, total = np.zeros((8, 256), np.int64), 0
    for h in hashes:
        octets, total = h.view(np.uint8).reshape(-1, 8), total + len(h)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256)
    over = (counts @ _BITS).reshape(64) * 2 > total
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text over its shingles, repeats included; zero without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) per row of docs (doc_id, text); a null text is an empty one."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1)  # each is made bytes when its turn comes, so that a batch isn't held twice
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each unsigned fingerprint in Gray order: neighbours differ in one bit."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Tree:
    """Gray-sorted fingerprints under levels of nodes, FANOUT children each."""

    FANOUT = 16

    def __init__(self, rows: np.ndarray):
        """rows: (fp, more, labels); the tree is over fp."""
        self.rows = rows[np.argsort(gray_rank(rows[:, 0]), kind="stable")]
        self.fps, self.more = (np.ascontiguousarray(self.rows[:, k]) for k in range(2))
        ands, ors = self.fps, self.fps
        self.levels = []  # from the leaves up: (mask of shared bits, pattern)
        while True:
            cuts = np.arange(0, len(ands), self.FANOUT)
            ands, ors = np.bitwise_and.reduceat(ands, cuts), np.bitwise_or.reduceat(ors, cuts)
            self.levels.append((~(ands ^ ors), ands))
            if len(cuts) == 1:
                break

    def size(self, level: int) -> int:
        return len(self.fps) if level < 0 else len(self.levels[level][0])

    def node(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level < 0:
            return np.full(len(at), ~np.uint64(0)), self.fps[at]
        return self.levels[level][0][at], self.levels[level][1][at]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def flat(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def _grow(a: np.ndarray, b: np.ndarray, of_a: Tree, of_b: Tree, la: int, lb: int, same: bool):
    """The children of node pairs (a at level la, b at lb); of two equal trees each pair once."""

    def kids(at, tree, level):
        low = at * Tree.FANOUT
        return low, np.minimum(low + Tree.FANOUT, tree.size(level - 1)) - low

    (a0, na), (b0, nb) = kids(a, of_a, la), kids(b, of_b, lb)
    n = na * nb
    i = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = a0[i] + k // nb[i], b0[i] + k % nb[i]
    if same:
        keep = x <= y
        x, y = x[keep], y[keep]
    return x, y


_PAIRS = 1 << 10  # node pairs opened at once: 256 times as many child pairs
_MET = 1 << 17  # pairs of members compared at once
_CROWDED = 1 << 12  # pairs of members of two buckets, from which they meet as trees


def close_pairs(ta: Tree, tb: Tree, most: int, labels, lead: np.uint64 = np.uint64(0), near: int = 0):
    """Yields (places in ta, places in tb) of pairs at most bits apart in fp and more together; of one tree each pair once.

    Node pairs go down a stack; a pair goes on if its shared bits differ in at most `most` places, of which
    at most `near` are in lead (where that isn't zero). labels() gives both trees' members' labels as they
    are then: pairs of leaves whose members all have one label are passed over, and so are pairs of one label.
    """
    same = ta is tb
    la, lb = len(ta.levels) - 1, len(tb.levels) - 1
    stack = [(la, lb, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        if len(a) > _PAIRS:
            stack.append((la, lb, a[_PAIRS:], b[_PAIRS:]))
            a, b = a[:_PAIRS], b[:_PAIRS]
        (ma, pa), (mb, pb) = ta.node(la, a), tb.node(lb, b)
        apart = (pa ^ pb) & ma & mb
        close = np.bitwise_count(apart) <= most
        if lead:
            close &= np.bitwise_count(apart & lead) <= near
        a, b = a[close], b[close]
        if not len(a):
            continue
        if la < 0 and lb < 0:
            close = np.bitwise_count(ta.fps[a] ^ tb.fps[b]).astype(int) + np.bitwise_count(ta.more[a] ^ tb.more[b]) <= most
            if same:
                close &= a != b
            ra, rb = labels()
            close &= ra[a] != rb[b]
            if close.any():
                yield a[close], b[close]
            continue
        if la == 0 and lb == 0:
            ra, rb = labels()
            cut_a, cut_b = np.arange(0, len(ra), Tree.FANOUT), np.arange(0, len(rb), Tree.FANOUT)
            one_a = np.minimum.reduceat(ra, cut_a) == np.maximum.reduceat(ra, cut_a)
            one_b = np.minimum.reduceat(rb, cut_b) == np.maximum.reduceat(rb, cut_b)
            done = one_a[a] & one_b[b] & (ra[cut_a[a]] == rb[cut_b[b]])
            a, b = a[~done], b[~done]
            half = len(a) // 2  # the first half's links may settle the second
            if half > 64:
                stack.append((la, lb, a[half:], b[half:]))
                a, b = a[:half], b[:half]
            if not len(a):
                continue
        if la > lb:
            low = a * Tree.FANOUT
            n = np.minimum(low + Tree.FANOUT, ta.size(la - 1)) - low
            x = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((la - 1, lb, x, np.repeat(b, n)))
        elif lb > la:
            low = b * Tree.FANOUT
            n = np.minimum(low + Tree.FANOUT, tb.size(lb - 1)) - low
            y = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((la, lb - 1, np.repeat(a, n), y))
        else:
            x, y = _grow(a, b, ta, tb, la, lb, same)
            stack.append((la - 1, lb - 1, x, y))


def lead_pairs(ta: Tree, tb: Tree, most: int, labels, lead: np.uint64, near: int):
    """The pairs of close_pairs() for lead bits at the front of a fingerprint and near of 0 or 1, but for some of one label.

    Members that are equal in lead lie together in Gray order: each such bucket meets itself, and for near = 1 those
    one bit of lead away, which are looked up. So the work is about the pairs that agree in lead, whatever the
    nodes above share. Crowded buckets meet as trees, unless all have one label.
    """
    same = ta is tb

    def buckets(t: Tree):
        keys = t.fps & lead
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[cuts], gray_rank(keys[cuts]), cuts, np.diff(np.append(cuts, len(keys)))

    ka, _, at_a, size_a = buckets(ta)
    kb, rank_b, at_b, size_b = buckets(tb)
    bits = [b for b in (np.uint64(1) << np.arange(64, dtype=np.uint64)) if b & lead] if near else []
    for flip in [np.uint64(0), *bits]:
        i = np.flatnonzero(ka & flip == 0) if same else np.arange(len(ka))  # of one tree each pair of buckets once
        rank = gray_rank(ka[i] ^ flip)
        j = np.minimum(np.searchsorted(rank_b, rank), len(rank_b) - 1)
        i, j = (x[rank_b[j] == rank] for x in (i, j))
        n = size_a[i] * size_b[j]
        for p, q in zip(i[n > _CROWDED].tolist(), j[n > _CROWDED].tolist()):
            own, other = slice(at_a[p], at_a[p] + size_a[p]), slice(at_b[q], at_b[q] + size_b[q])
            ra, rb = (x[cut] for x, cut in zip(labels(), (own, other)))
            if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
                continue
            sub = Tree(ta.rows[own])  # sorted already: places stay
            for a, b in close_pairs(sub, sub if same and not flip else Tree(tb.rows[other]), most, lambda: tuple(x[cut] for x, cut in zip(labels(), (own, other)))):
                yield a + own.start, b + other.start
        light = n <= _CROWDED
        i, j, n = i[light], j[light], n[light]
        ends = np.cumsum(n)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + _MET, side="right")))
            p, q, m = i[low:high], j[low:high], n[low:high]
            of = np.repeat(np.arange(len(m)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a, b = at_a[p][of] + k // size_b[q][of], at_b[q][of] + k % size_b[q][of]
            low = high
            if same and not flip:
                once = a < b
                a, b = a[once], b[once]
            apart = np.bitwise_count(ta.fps[a] ^ tb.fps[b])
            close = apart <= most
            a, b, apart = a[close], b[close], apart[close]
            close = apart + np.bitwise_count(ta.more[a] ^ tb.more[b]) <= most  # 128 at most: eight bits hold it
            a, b = a[close], b[close]
            if len(a):
                ra, rb = labels()
                apart = ra[a] != rb[b]
                if apart.any():
                    yield a[apart], b[apart]


def near_pairs(ta: Tree, tb: Tree, most: int, labels, lead: np.uint64 = np.uint64(0), near: int = 0):
    """close_pairs(), by buckets of equal lead bits where that is less work."""
    if lead and near < 2 and len(ta.fps) and len(tb.fps):
        return lead_pairs(ta, tb, most, labels, lead, near)
    return close_pairs(ta, tb, most, labels, lead, near)


def links(own: np.ndarray, guests: np.ndarray | None, most: int, lead: np.uint64 = np.uint64(0), near: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of own (rows of fp, more and node) among themselves, or with guests, as trees: nodes, and the least nodes of their trees.

    Rows of one node are in one tree from the start. What is in one tree already isn't compared, so a
    large group of close fingerprints costs about its size, not its square.
    """
    ta = Tree(own)
    tb = ta if guests is None else Tree(guests)
    nodes, of = np.unique((ta.rows if guests is None else np.concatenate([ta.rows, tb.rows]))[:, 2].view(np.int64), return_inverse=True)
    of_a, of_b = of[: len(ta.rows)], of[len(of) - len(tb.rows) :]
    forest = Forest(len(nodes))

    def labels():
        up = forest.flat()
        return up[of_a], up[of_b]

    for a, b in near_pairs(ta, tb, most, labels, lead, near):
        for i, j in zip(of_a[a].tolist(), of_b[b].tolist()):
            forest.join(i, j)
    up = forest.flat()  # roots are least
    moved = up != np.arange(len(up))
    return nodes[moved], nodes[up[moved]]


class Turn:
    """A fixed rearrangement of the 64 bits that brings some of them to the front; turn 0 leaves them."""

    def __init__(self, number: int):
        order = np.random.default_rng(number).permutation(64) if number else np.arange(64)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64)).reshape(8, 8)
        self.there = (_BITS.astype(np.uint64)[None] * bits[:, None]).sum(axis=2, dtype=np.uint64)  # [k][byte]: where the bits of the kth byte go

    def turned(self, fps: np.ndarray) -> np.ndarray:
        octets = np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8)
        return np.bitwise_or.reduce([self.there[k][octets[:, k]] for k in range(8)], axis=0)


LEAF = 256  # fingerprints in a block that travels to another range
_HELD = 1 << 20  # pairs that a task keeps before it passes them on
OWN = 1 << 20  # rows that a range of the top level has, about, and a task holds as one tree
RANGES = 4096  # ranges at a time, or those of one turn; their masks are all that the driver and every task hold


def batches_of(rows: int, turns: range, parts: int) -> list[tuple[range, int]]:
    """(turns, ranges): turns that are searched together, and over how many ranges. A range has OWN rows at most, about.

    parts ranges at least share the work; beyond RANGES turns are searched one after the other.
    """
    each = max(1, min(len(turns), RANGES * OWN // max(1, rows)))
    return [(t := turns[k : k + each], max(min(parts, RANGES), -(-rows * len(t) // OWN))) for k in range(0, len(turns), each)]


def _blocks(distinct: DataFrame, labels: list[str], ranges: int, turns: range) -> DataFrame:
    """Blocks of up to LEAF rows (fp, more, labels) in Gray order: (turn, part, fps binary, mask, pattern); a part is a range of one turn."""
    width = 2 + len(labels)

    def ranked(batches):
        import pyarrow as pa

        for b in batches:
            halves = [b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2)]
            for t in turns:
                moved = Turn(t).turned(halves[t % 2])  # odd turns are over the other half
                rank = (gray_rank(moved) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is rank order
                cols = [pa.array(x.view(np.int64)) for x in (moved, halves[1 - t % 2])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(moved), t, np.int32)), *cols, *b.columns[2:], pa.array(rank)], names=["turn", "fp", "more", *labels, "rank"])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, rest = TaskContext.get().partitionId(), -1, np.zeros((0, width), np.uint64)

        def packed(fps):
            cuts = np.arange(0, len(fps), LEAF)
            ands, ors = np.bitwise_and.reduceat(fps[:, 0], cuts), np.bitwise_or.reduceat(fps[:, 0], cuts)
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * len(cuts), pa.int32()), pa.array([at * ranges + part] * len(cuts), pa.int32()), pa.array([fps[i : i + LEAF].tobytes() for i in cuts], pa.binary()), pa.array((~(ands ^ ors)).view(np.int64)), pa.array(ands.view(np.int64))],
                names=["turn", "part", "fps", "mask", "pattern"],
            )

        for b in batches:
            turn = b.column(0).to_numpy()
            fps = np.stack([b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(1, 1 + width)], axis=1)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]))
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if turn[i] != at:
                    if len(rest):
                        yield packed(rest)
                    at, rest = int(turn[i]), np.zeros((0, width), np.uint64)
                rest = np.concatenate([rest, fps[i:j]])
                if whole := len(rest) // LEAF * LEAF:
                    yield packed(rest[:whole])
                    rest = rest[whole:]
        if len(rest):
            yield packed(rest)

    schema = ", ".join(["turn int", *(f"{c} long" for c in ("fp", "more", *labels, "rank"))])
    order = ["turn", "rank", "more", *labels]  # fingerprints that are equal may lie in several ranges
    sorted_ = distinct.select("fp", "more", *labels).mapInArrow(ranked, schema).repartitionByRange(ranges, *order).sortWithinPartitions("turn", "rank")
    return sorted_.mapInArrow(cut, "turn int, part int, fps binary, mask long, pattern long")


def search(distinct: DataFrame, labels: list[str], found, most: int, turns: range = range(1), front: int = 0, near: int = 0) -> DataFrame:
    """(a, b) longs, distinct: what found(own, guests or None, lead, near) makes of rows (fp, more, labels) that may be close.

    Ranges of the Gray order are the top nodes. A block goes to each later range whose shared bits differ
    from its own in at most `most` places, and meets there that range's own tree. With one turn and no
    front that is every link. A large `most` leaves little to prune; then each of `turns` rearrangements
    only follows pairs whose `front` leading bits differ in at most `near` places.
    """
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = [_searched(distinct, labels, found, most, some, ranges, front, near) for some, ranges in batches_of(distinct.count(), turns, parts)]
    if len(made) == 1:
        return made[0]
    whole = reduce(DataFrame.union, made, distinct.sparkSession.createDataFrame([], "a long, b long"))
    return materialize(whole.distinct(), "simhash_all_links")


def _searched(distinct: DataFrame, labels: list[str], found, most: int, turns: range, ranges: int, front: int, near: int) -> DataFrame:
    """search() of some turns over so many ranges."""
    blocks = materialize(_blocks(distinct, labels, ranges, turns), "simhash_blocks")
    tops = blocks.groupBy("turn", "part").agg(
        F.expr("bit_and(pattern)").alias("ands"), F.expr("bit_or(~mask | pattern)").alias("ors"),
    ).collect()  # fmt: skip  # at most ranges + turns rows
    turn, part = (np.array([r[k] for r in tops], np.int64) for k in ("turn", "part"))
    ands, ors = (np.array([r[k] for r in tops], np.int64).view(np.uint64) for k in ("ands", "ors"))
    mask = ~(ands ^ ors)
    lead = np.uint64(((1 << front) - 1) << (64 - front)) if front else np.uint64(0)
    width = 2 + len(labels)

    def route(batches):
        import pyarrow as pa

        for b in batches:
            of, home, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            m, p = (b.column(k).to_numpy().view(np.uint64) for k in (3, 4))
            for at in range(0, len(of), 64):
                to = slice(at, at + 64)
                apart = (p[to, None] ^ ands[None]) & m[to, None] & mask[None]
                close = (np.bitwise_count(apart) <= most) & (turn[None] == of[to, None]) & (part[None] >= home[to, None])
                if front:
                    close &= np.bitwise_count(apart & lead) <= near
                i, j = np.nonzero(close)
                yield pa.RecordBatch.from_arrays([pa.array(part[j].astype(np.int32)), pa.array(home[to][i] == part[j]), fps.take(pa.array(i + at))], names=["to", "own", "fps"])

    def meet(batches):
        """Rows come sorted by range, its own blocks first."""
        import pyarrow as pa

        at, own, guests, held = None, [], [], [np.zeros((0, 2), np.int64)]

        def keep(*sides):
            """Turns and ranges of one task find much the same; it goes on once."""
            held.append(np.stack([x.view(np.int64) for x in found(*sides, lead, near)], axis=1))
            if sum(map(len, held)) > _HELD:
                once = np.unique(np.concatenate(held), axis=0)
                held[:] = [once[:0]] if len(once) > _HELD // 2 else [once]
                if not len(held[0]):
                    yield batch(once)

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])

        def settle(last):
            if guests:
                yield from keep(np.concatenate(own), np.concatenate(guests))
                guests.clear()
            if last and own:
                yield from keep(np.concatenate(own), None)

        for b in batches:
            for to, mine, fps in zip(*(b.column(k).to_pylist() for k in range(3))):
                if to != at:
                    yield from settle(True)
                    at, own = to, []
                (own if mine else guests).append(np.frombuffer(fps, np.uint64).reshape(-1, width))
                if len(guests) >= 4096:  # a million fingerprints
                    yield from settle(False)
        yield from settle(True)
        yield batch(np.unique(np.concatenate(held), axis=0))

    routed = blocks.mapInArrow(route, "to int, own boolean, fps binary").repartition(ranges, "to").sortWithinPartitions("to", F.col("own").desc())
    made = materialize(routed.mapInArrow(meet, "a long, b long").distinct(), "simhash_links")
    drop(blocks)
    return made


def link_forest(distinct: DataFrame, most: int, turns: range = range(1), front: int = 0, near: int = 0) -> DataFrame:
    """(a, b): links between nodes that join those of distinct (fp, more, node) that chains of at most `most` bits join.

    Each node comes with the least one of its tree: so turns that find the same tree give the same links.
    """

    def found(own, guests, lead, near):
        return links(own, guests, most, lead, near)

    return search(distinct, ["node"], found, most, turns, front, near)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that chains of edges (a, b) reach, for every node with an edge.

    Alternates large and small stars until every node has one edge, to a node that has none. Each node's
    least neighbour is written to the shared folder before it is joined, as the edges are after each
    round: both sides of a join are then plain tables, so Spark can split the rows of a hub. What a round
    leaves behind goes when the next one is written.
    """
    passed: list[DataFrame] = []

    def linked(e: DataFrame, name: str) -> DataFrame:
        low = materialize(e.groupBy("u").agg(F.min("v").alias("m")), name)
        passed.append(low)
        return e.join(low, "u")

    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    for k in range(rounds):
        n = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if n["n"] == n["d"] and e.join(e.select(F.col("u").alias("again")), F.col("v") == F.col("again"), "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = linked(both, f"cc{k}_large").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")
        large = materialize(large.distinct(), f"cc{k}_half")
        small = linked(large, f"cc{k}_small")
        passed += [e, large]
        e = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, f"cc{k}")
        drop(*passed)
        passed.clear()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text).

    component_id is the smallest doc_id whose fingerprint chains of links reach, the row's own included.
    Rows that repeat a doc_id keep a row each; a null doc_id counts only where a component has no other.
    Null and empty texts have fingerprint zero and link like any other; no rows give no rows. Every link
    is found.
    """
    fps = materialize(fingerprints(docs, width), "simhash_fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash_distinct")
    roots = components(link_forest(distinct.select("fp", F.lit(0).cast("long").alias("more"), F.col("fp").alias("node")), most))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash_roots")
    # written before they are joined, so that Spark can split a large component's nodes and a large group of copies
    least = materialize(named.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id")), "simhash_least")
    named = materialize(named.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("key"), "component_id"), "simhash_components")
    return fps.join(named, F.col("fp") == F.col("key"), "left").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
