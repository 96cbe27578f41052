"""Groups of texts that share most of their five-word shingles: SimHash finds who may, their shingles decide.

Each set of shingles has 128 bits of SimHash. Sets within MOST bits, found by rearranged Gray-order indexes,
form families; only sets with family are made again from their texts. They lie in blocks, which are
compared as wholes, all members of one with all of the other, by products of matrices. First those
blocks meet that links of the families join; then only what is close and still apart. So a large group of
similar texts costs about its size, and no pair becomes a row.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, materialize
from .sieve import kept
from .simhash import SEED, Forest, components, gray_rank, link_forest, majority, near_pairs, search, Tree

WIDTH = 5
MOST = 28  # bits of 128; sets that share 0.8 of all are 19.4 bits apart, with a deviation of 4
MISSED = 0.005  # share of pairs at 19.4 bits that no rearrangement may bring together
FIRST = 2  # rearrangements that are searched before the others, which then pass over what these have joined
CROWD = 16  # unlike sets that one meets in a rearrangement, about
BLOCK = 64  # sets of a block
WEIGHT = 1 << 20  # bytes of sets after which a block is full
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = 1 << 13  # shingles of two blocks in a matrix at a time


def members(text: bytes) -> np.ndarray:
    """The text's different shingles, as sorted hashes: A-Z are lowered, fewer than WIDTH words make one, no words none.

    A shingle's hash is made of its words' XXH64, so each word is hashed once; those that differ in one word never collide.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    width = min(WIDTH, len(words))
    made = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        made = made * _ODD + each[k : k + len(made)]
    made = np.sort(mixed(made))
    return made[np.concatenate(([True], made[1:] != made[:-1]))]


def mixed(x: np.ndarray) -> np.ndarray:
    """Another well spread value for each of x (multiplications wrap)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar(n, m, common):
    """Whether sets of n and m members, common ones included, share 0.8 of all; in whole numbers."""
    return 9 * common >= 4 * (n + m)


def settings(n: int) -> dict:
    """turns, front and near for link_forest() over n sets: the recall is the same at every n.

    front grows with n so that about CROWD unlike sets stay, and turns with front.
    """
    front = next(f for f in range(4, 64) if n * (f + 1) <= CROWD << f)
    p = math.acos(1.6 / 1.8) / math.pi  # of a bit to differ, for sets of one size that share 0.8 of all
    meets = (1 - p) ** front + front * p * (1 - p) ** (front - 1)
    return {"turns": range(max(FIRST, math.ceil(math.log(MISSED) / math.log(1 - meets)))), "front": front, "near": 1}


def sketches(docs: DataFrame) -> DataFrame:
    """(key, d1, d2, fp, more) per row of docs (key, text): 128 bits that name the set, and 128 bits of SimHash."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                m = members(t or b"")
                rows.append((*np.frombuffer(xxh3_128_digest(m.tobytes()), np.int64).tolist(), *np.array([majority([m]), majority([mixed(m)])], np.uint64).view(np.int64).tolist()))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(4))], names=["key", "d1", "d2", "fp", "more"])

    narrow = docs.select("key", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, d1 long, d2 long, fp long, more long")


_BLOCK_SCHEMA = "block long, families array<long>, ids array<long>, fps binary, sizes array<long>, sets binary"


def blocks_of(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Blocks of suspects (id, family, low) in order of family and Gray rank; their sets are made from the text of low.

    A family of up to half a block isn't divided, but between two tasks' ranges.
    """

    def made(batches):
        import pyarrow as pa

        for b in batches:
            sets = [members(t or b"") for t in b.column(2).to_pylist()]
            fps = np.array([(majority([m]), majority([mixed(m)])) for m in sets], np.uint64).reshape(-1, 2)
            rank = (gray_rank(fps[:, 0]) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is rank order
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(rank), pa.array([x.tobytes() for x in fps], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["id", "family", "rank", "fps", "sets"],
            )

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        nth, held, weight, last = TaskContext.get().partitionId() << 33, [], 0, None

        def full():
            nonlocal nth, held, weight
            block = [[nth], [[h[1] for h in held]], [[h[0] for h in held]], [b"".join(h[2] for h in held)], [[len(h[3]) // 8 for h in held]], [b"".join(h[3] for h in held)]]
            nth, held, weight = nth + 1, [], 0
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(block, kinds)], names=["block", "families", "ids", "fps", "sizes", "sets"])

        for b in batches:
            for node, family, _, fps, sets in zip(*(c.to_pylist() for c in b.columns)):
                if node == last:  # rows that are equal in all columns have one key
                    continue
                if held and (len(held) >= BLOCK or weight + len(sets) > WEIGHT or (len(held) >= BLOCK // 2 and held[-1][1] != family)):
                    yield full()
                held.append((node, family, fps, sets))
                weight, last = weight + len(sets), node
        if held:
            yield full()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = suspects.select("id", "family", F.col("low").alias("key"))
    rows = kept(docs.select("key", F.col("text").cast("binary").alias("text")), wanted.select("key"), F.xxhash64("key"))
    same = [F.col(f"d.key.{f}").eqNullSafe(F.col(f"w.key.{f}")) for f in docs.schema["key"].dataType.names]
    on = F.xxhash64("d.key") == F.xxhash64("w.key")
    for x in same:
        on = on & x
    texts = rows.alias("d").join(wanted.alias("w"), on).select("w.id", "w.family", "d.text")
    sets = texts.mapInArrow(made, "id long, family long, rank long, fps binary, sets binary")
    order = ["family", "rank", "id"]
    return sets.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK_SCHEMA)


class Block:
    def __init__(self, ids: list[int], fps: bytes, sizes: list[int], sets: bytes):
        self.ids, self.n = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.fps = np.frombuffer(fps, np.uint64).reshape(-1, 2)
        self.sets = np.frombuffer(sets, np.uint64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)


def within_bits(x: Block, y: Block) -> np.ndarray:
    """Which sets of x and y have fingerprints within MOST bits."""
    return np.bitwise_count(x.fps[:, None, 0] ^ y.fps[None, :, 0]).astype(int) + np.bitwise_count(x.fps[:, None, 1] ^ y.fps[None, :, 1]) <= MOST


def compared(x: Block, y: Block, near=within_bits) -> tuple[np.ndarray, np.ndarray]:
    """Links between similar sets of two blocks, or within one, as a spanning forest: pairs of ids. Only sets that near(x, y) names are compared."""
    close = near(x, y)
    close &= similar(x.n[:, None], y.n[None], np.minimum(x.n[:, None], y.n[None]))
    if x is y:
        close &= np.arange(len(x.n))[:, None] < np.arange(len(y.n))[None]
    if not close.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.intersect1d(x.sets, y.sets) if x is not y else np.unique(x.sets)

    def columns(b: Block):
        at = np.minimum(np.searchsorted(both, b.sets), len(both) - 1)
        has = both[at] == b.sets
        return at[has], b.row[has]

    (ax, rx), (ay, ry) = (columns(b) for b in (x, y)) if len(both) else [(np.zeros(0, int),) * 2] * 2
    common = np.zeros(close.shape, np.int64)
    for low in range(0, len(both), _COLUMNS):
        part = []
        for at, row, b in ((ax, rx, x), (ay, ry, y)):
            m, inside = np.zeros((len(b.n), _COLUMNS), np.float32), (at >= low) & (at < low + _COLUMNS)
            m[row[inside], at[inside] - low] = 1
            part.append(m)
        common += (part[0] @ part[1].T).astype(np.int64)
    i, j = np.nonzero(close & similar(x.n[:, None], y.n[None], common))
    shift, forest = (0 if x is y else len(x.n)), Forest(len(x.n) + len(y.n))
    new = np.array([forest.join(a, b + shift) for a, b in zip(i.tolist(), j.tolist())], bool)
    return (x.ids[i[new]], y.ids[j[new]]) if len(i) else (i, j)


def compare(pairs: DataFrame | None, blocks: DataFrame, near=within_bits) -> DataFrame:
    """(a, b): links that pairs (x, y) of blocks have, or each block in itself."""
    cols, alone = ["ids", "fps", "sizes", "sets"], pairs is None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[0] for c in (col.slice(k, 1).to_pylist() for col in batch.columns)]
                x = Block(*row[:4])
                a, b = compared(x, x if alone else Block(*row[4:]), near)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    if alone:
        both = blocks.select(*cols)
    else:
        half = pairs.join(blocks.select("block", *cols), F.col("x") == F.col("block")).select("y", *cols)
        other = blocks.select(F.col("block").alias("of"), *[F.col(c).alias(f"{c}_y") for c in cols])
        both = half.join(other, F.col("y") == F.col("of")).select(*cols, *[f"{c}_y" for c in cols])
    return both.mapInArrow(run, "a long, b long")


def _open_pairs(open_: DataFrame, turns: range, front: int, near: int) -> DataFrame:
    """(a, b): blocks that hold close sets of open_ (fp, more, root, block) which have unlike roots."""

    def found(own, guests, lead, near):
        ta = Tree(own)
        tb = ta if guests is None else Tree(guests)
        roots, held, waiting = (ta.rows[:, 2], tb.rows[:, 2]), [np.zeros((0, 2), np.int64)], 0
        for a, b in near_pairs(ta, tb, MOST, lambda: roots, lead, near):
            x, y = ta.rows[a, 3].view(np.int64), tb.rows[b, 3].view(np.int64)
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])
            waiting += len(a)
            if waiting > 1 << 20:
                held, waiting = [np.unique(np.concatenate(held), axis=0)], 0
        pairs = np.unique(np.concatenate(held), axis=0)
        return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    return search(open_.select("fp", "more", "root", "block"), ["root", "block"], found, MOST, turns, front, near)


def similar_groups(docs: DataFrame) -> DataFrame:
    """(key, component_id) per row of docs (key struct, text): the smallest key that chains of similar texts reach.

    Similar are texts with 0.8 or more of all their different five-word shingles in common; a text of fewer
    words is one shingle, and texts without words are all alike. Equal sets always meet. Of other similar
    pairs, those within MOST bits of SimHash are found, but for MISSED of those at the limit: tests hold
    recall against brute force. No pair that shares less becomes a link. Repeated rows keep a row each; no rows
    give no rows.
    """
    made = materialize(sketches(docs), "similar_sketches")
    distinct = made.groupBy("d1", "d2", "fp", "more").agg(F.min("key").alias("low"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "similar_distinct")
    how = settings(distinct.count())
    forest = link_forest(distinct.select("fp", "more", F.col("id").alias("node")), MOST, **(how | {"turns": how["turns"][:FIRST]}))
    roots = components(forest)
    rooted = distinct.select("id", "fp", "more").join(roots, F.col("id") == F.col("node"), "left").select("fp", "more", F.coalesce("root", "id").alias("node"))
    more = link_forest(materialize(rooted, "similar_rooted"), MOST, **(how | {"turns": how["turns"][FIRST:]}))
    forest = forest.union(more)
    family = materialize(components(forest), "similar_families")
    family = family.select("node", "root").union(family.select(F.col("root").alias("node"), "root").distinct())
    suspects = materialize(distinct.join(family, F.col("id") == F.col("node")).select("id", F.col("root").alias("family"), "low", "fp", "more"), "similar_suspects")
    blocks = materialize(blocks_of(docs, suspects), "similar_blocks")
    where = blocks.select("block", F.explode(F.arrays_zip("ids", "families")).alias("m")).select(F.col("m.ids").alias("of"), "block", F.col("m.families").alias("in"))
    where = materialize(where, "similar_places")
    over = forest.join(where.select(F.col("of").alias("a"), F.col("block").alias("x")), "a").join(where.select(F.col("of").alias("b"), F.col("block").alias("y")), "b")
    over = over.filter("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    over = materialize(over, "similar_meet")
    found = materialize(compare(None, blocks).union(compare(over, blocks)), "similar_links")

    # families in several blocks: what is close, still apart, and not compared yet
    roots = materialize(components(found), "similar_roots")
    placed = where.join(roots, F.col("of") == F.col("node"), "left").select("of", "block", "in", F.coalesce("root", "of").alias("root"))
    placed = materialize(placed, "similar_placed")
    apart = placed.groupBy("in").agg((F.min("root") != F.max("root")).alias("apart"), (F.min("block") != F.max("block")).alias("wide"))
    apart = apart.filter("apart AND wide").select(F.col("in").alias("still"))
    open_ = placed.join(apart, F.col("in") == F.col("still"), "left_semi").join(suspects.select("id", "fp", "more"), F.col("of") == F.col("id"))
    open_ = materialize(open_.select("fp", "more", "root", "block"), "similar_open")
    rest = _open_pairs(open_, **how).select(F.col("a").alias("x"), F.col("b").alias("y")).join(over, ["x", "y"], "left_anti")
    found = found.union(materialize(compare(materialize(rest, "similar_rest"), blocks), "similar_more_links"))
    drop(blocks, suspects, where, placed, open_)

    roots = components(found).withColumnRenamed("node", "linked")
    named = distinct.join(roots, F.col("id") == F.col("linked"), "left").select("d1", "d2", "low", F.coalesce("root", "id").alias("root"))
    named = materialize(named, "similar_named")
    # written before they are joined, so that Spark can split a large group's rows
    least = materialize(named.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id")), "similar_least")
    keys = materialize(named.join(least, F.col("root") == F.col("of")).select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "component_id"), "similar_ids")
    return made.select("key", "d1", "d2").join(keys, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select("key", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of similar texts (similar_groups), other rows of the group are left out.

    It is the one with the smallest doc_id, null last, then the least digest of the text, then of the row:
    so rows that only share their doc_id, or have none, are not taken for copies. Of equal rows one stays.
    No rows give no rows; columns of docs come back as they are, whatever their names.
    """
    key = {"none": F.col("doc_id").isNull(), "id": F.col("doc_id"), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "whole": F.xxhash64("*")}
    rows = docs.select(F.struct("*").alias("row"), *[x.alias(k) for k, x in key.items()])
    found = materialize(similar_groups(rows.select(F.struct(*key).alias("key"), F.col("row.text").alias("text"))), "similar_groups")
    stay = found.select("component_id.*").distinct().toDF(*[f"stays_{k}" for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"stays_{k}")) for k in ("id", "digest", "whole")]
    kept_ = rows.join(stay, same[0] & same[1] & same[2], "left_semi")
    repeats = not found.groupBy("key").count().filter("count > 1").isEmpty()
    return (kept_.dropDuplicates(list(key)) if repeats else kept_).select("row.*")
