"""Texts that share 0.8 or more of all their five-word shingles: every such pair is linked, by parity sketches.

A sketch has a number of words that depends on the band of a set's size. Each shingle's hash is XORed into the
word that its leading bits name, so two sketches differ in at most as many words as the sets have members
that aren't common: their distance is a lower bound of the symmetric difference. Sets of n and m members that
share 0.8 differ in (n + m) / 9 at most, so of one more words at least one is equal (pigeonhole). Words are put
in one order, those of most shingles first; then it is among the first d + 1 of both sketches, and these are
joined. A word holds several shingles, so a passage that many texts hold seldom makes one.

Sketches of single bits, more for larger sets, bound the symmetric difference again, pair by pair, and what they
leave open is verified on the sets, which lie in blocks: sets that chains of open pairs join lie together, so few
blocks travel to meet another. First each word's sets meet one of them. Words whose sets these links have
joined are done; in the others each group meets the closest set outside it, for some rounds. What may be similar and
is apart even then meets block by block. So a large group costs about its size, and of a word no more pairs become
rows than it has sets.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, materialize
from .similar import Block, blocks_of, compare, members, mixed
from .sieve import kept
from .simhash import components

WIDTH = 5
BITS = 1 << 10  # of a set's second sketch, of single bits, at least
WIDEST = 1 << 14  # and at most where it goes with each of the set's words
REPEATS = 1 << 16  # sets that a task knows again, so that copies don't send their words again
CROWD = 1 << 11  # sets of a word outside its largest group, beyond which another word must be common too
ROUNDS = 4  # in which groups meet the closest set outside, at most; fewer where one joins nothing
FEW = 1 << 13  # closest pairs of a round after which there is no other
_HELD = 1 << 16  # rows that a task keeps before it passes them on
_FAR = 1 << 40  # the slack of what can't be similar


def partners(n: int) -> int:
    """Members of the largest set that can share 0.8 with one of n."""
    return n * 5 // 4


def differ(n: int) -> int:
    """Members that a set of n and a set that shares 0.8 with it don't have in common, at most."""
    return (n + partners(n)) // 9


def band(n: int) -> int:
    """Leading bits that name a word of the sketch of a set of n: more words than may differ, of up to 3.5 shingles."""
    bits = 4
    while n * 2 > 7 << bits:
        bits += 2
    return bits


def sketch_words(m: np.ndarray, bits: int, take: int) -> np.ndarray:
    """The first take of the 2**bits words of sorted hashes m: those of most members first, then by their value."""
    at = m >> np.uint64(64 - bits)
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(cuts, len(m)))
    where, value = at[cuts], np.bitwise_xor.reduceat(m, cuts)
    if len(cuts) < take:  # words without members come last, and are words like others
        rest = np.setdiff1d(np.arange(1 << bits, dtype=np.uint64), where)
        where, value, count = np.concatenate([where, rest]), np.concatenate([value, np.zeros(len(rest), np.uint64)]), np.concatenate([count, np.zeros(len(rest), np.int64)])
    key = mixed(value ^ mixed((where << np.uint64(8)) | np.uint64(bits)))
    return key[np.lexsort((key, -count))[:take]]


def words_of(m: np.ndarray, more: int = 0) -> np.ndarray:
    """Words that m shares at least 1 + more of with any set that shares 0.8 with it: for its own band and that of its largest partner."""
    n = len(m)
    if not differ(n):
        return np.zeros(0, np.uint64)  # only equal sets
    take = differ(n) + 1 + more
    return np.concatenate([sketch_words(m, bits, take) for bits in sorted({band(n), band(partners(n))})])


def sketched(docs: DataFrame) -> DataFrame:
    """(key, d1, d2, n, words, bits) per row of docs (key, text): 128 bits that name the set, its size, its words, two of which are shared, and its bit sketch.

    words and bits are null where the task has just told those of an equal set.
    """

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        known: dict[bytes, None] = {}
        for b in batches:
            names, sizes, words, bits = [], [], [], []
            for t in b.column(1).to_pylist():
                m = members(t or b"")
                name = xxh3_128_digest(m.tobytes())
                names.append(name)
                sizes.append(len(m))
                words.append(None if name in known else words_of(m, 1).view(np.int64))
                bits.append(None if name in known else bit_sketch(m))
                known[name] = None
                if len(known) > REPEATS:
                    del known[next(iter(known))]
            digest = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            cols = [b.column(0), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in range(2)), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "d1", "d2", "n", "words", "bits"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, d1 long, d2 long, n long, words array<long>, bits binary")


def _firsts(n, words):
    """Of words with two shared ones those of which one is: without the last of each band."""
    per = F.floor((n + F.floor(n * 5 / 4)) / 9).cast("int") + 2
    first, second = F.slice(words, F.lit(1), per - 1), F.slice(words, per + 1, per - 1)
    return F.when(F.size(words) > 0, F.concat(first, F.when(F.size(words) > per, second).otherwise(F.array().cast("array<bigint>"))))


def _shared(words: DataFrame, distinct: DataFrame, name: str) -> DataFrame:
    """(word, id, hub, k): the words (word, d1, d2) that k sets of distinct (d1, d2, id) have, k > 1; hub is the least id.

    Of words that the same sets have one stays.
    """
    often = materialize(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word"), f"{name}_often")
    rows = kept(words, often, F.col("word")).join(often.withColumnRenamed("word", "of"), F.col("word") == F.col("of")).select("word", "d1", "d2").distinct()
    named = distinct.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "id")
    all_ = materialize(rows.join(named, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).select("word", "id"), f"{name}_all")
    per = all_.groupBy("word").agg(F.count("*").alias("k"), F.min("id").alias("hub"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = materialize(per.filter("k > 1").groupBy("k", "hub", "x", "y").agg(F.min("word").alias("w")).select("w", "hub", "k"), f"{name}_once")
    made = materialize(all_.join(one, F.col("word") == F.col("w")).select("word", "id", "hub", "k"), f"{name}_words")
    drop(often, all_, one)
    return made


def width(n: int, most: int | None = WIDEST) -> int:
    """Bits of the second sketch of a set of n. With fewer, two large sets that share nothing would not differ in enough of them."""
    bits = BITS
    while 2 * n > 3 * bits and bits != most:
        bits *= 2
    return bits


def bit_sketches(sets: np.ndarray, row: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """bits bits per set: each member turns over one. Two differ in at most as many bits as members aren't common."""
    odd = np.bincount(row * bits + (mixed(sets) & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64)


def bit_sketch(m: np.ndarray, most: int | None = WIDEST) -> bytes:
    """The sketch of one set, of its width."""
    return bit_sketches(m, np.zeros(len(m), np.int64), 1, width(len(m), most)).tobytes()


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches as they are with so many words: halves turn over the same bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _by_width(bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, sketches) of each width among bits."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    at = [np.flatnonzero(size == w) for w in np.unique(size)]
    return [(k, np.frombuffer(b"".join(bits[k]), np.uint64).reshape(len(k), -1)) for k in at]


def slack(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sets of n and m members with bit sketches a and b (bytes) how close they may be: least is closest, none above 0 share 0.8."""
    out = np.full((len(n), len(m)), _FAR)
    for (i, x), (j, y) in product(_by_width(a), _by_width(b)):
        words = min(x.shape[1], y.shape[1])
        if max(x.shape[1], y.shape[1]) <= 2 * words:  # else one is too large for the other
            y = _folded(y, words)
            for k, sketch in zip(i, _folded(x, words)):
                out[k, j] = 9 * np.bitwise_count(sketch ^ y).sum(axis=1, dtype=np.int64) - (n[k] + m[j])
    out[5 * np.minimum(n[:, None], m[None]) < 4 * np.maximum(n[:, None], m[None])] = _FAR
    return out


def within_bound(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sets of n and m members with bit sketches a and b may share 0.8."""
    return slack(n, m, a, b) <= 0


def pairs_within_bound(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of each set with the one at its place in the other list."""
    may = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    for (i, x), (j, y) in product(_by_width(a), _by_width(b)):
        at, left, right = np.intersect1d(i, j, assume_unique=True, return_indices=True)
        words = min(x.shape[1], y.shape[1])
        far = np.bitwise_count(_folded(x[left], words) ^ _folded(y[right], words)).sum(axis=1, dtype=np.int64)
        may[at] &= 9 * far <= n[at] + m[at]
    return may


def _near(x: Block, y: Block) -> np.ndarray:
    return within_bound(x.n, y.n, *(_objects([bit_sketch(m, None) for m in np.split(b.sets, np.cumsum(b.n)[:-1])]) for b in (x, y)))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sets (id, n, bits) those that may share 0.8."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 4))
            a, b = (_objects(batch.column(k).to_pylist()) for k in (3, 5))
            may = pairs_within_bound(n, m, a, b)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(may))

    one, two = (sets.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    both = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    return both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def _largest(words: DataFrame, roots: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """words (word, id) with root, and per word with several roots: main, the root that most of its sets have, and minors, how many have another."""
    rooted = materialize(words.join(roots, F.col("id") == F.col("node"), "left").select("word", "id", F.coalesce("root", "id").alias("root")), f"{name}_rooted")
    per = rooted.groupBy("word", "root").agg(F.count("*").alias("c")).groupBy(F.col("word").alias("w"))
    top = per.agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("minors")).filter("minors > 0")
    return rooted, materialize(top, f"{name}_largest")


def _apart(words: DataFrame, told: DataFrame, distinct: DataFrame, roots: DataFrame, name: str) -> list[tuple[DataFrame, DataFrame]]:
    """What _largest() gives for words, and for pairs of words where one is crowded.

    Sets with a crowded word in common have another one in common too, if they share 0.8.
    """
    rooted, top = _largest(words, roots, name)
    crowds = top.filter(F.col("minors") > CROWD).select("w")
    if crowds.isEmpty():
        return [(rooted, top)]
    crowded = rooted.join(crowds, F.col("word") == F.col("w"), "left_semi")
    arrays = told.select("d1", "d2", "words").join(distinct.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("id").alias("of")), (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")))
    twice = crowded.join(arrays, F.col("id") == F.col("of")).select("word", F.explode("words").alias("also"), "d1", "d2").filter("word != also")
    twice = twice.select(F.xxhash64(F.least("word", "also"), F.greatest("word", "also")).alias("word"), "d1", "d2")
    twice = _shared(materialize(twice.distinct(), f"{name}_both"), distinct, f"{name}_twice")
    return [(rooted, top.filter(F.col("minors") <= CROWD)), _largest(twice, roots, f"{name}_twice")]


def _closest(x, y, far) -> np.ndarray:
    """(root, slack, a, b): of each set the closest one on the other side that may share 0.8."""
    out = []
    for one, other, by in ((x, y, far), (y, x, far.T)):
        at = by.argmin(axis=1)
        least = by[np.arange(len(at)), at]
        ids, to = one[0], other[0][at]
        out.append(np.stack([one[2], least, np.minimum(ids, to), np.maximum(ids, to)], axis=1)[least <= 0])
    return np.concatenate(out)


def _first_of_root(rows: np.ndarray) -> np.ndarray:
    """Of rows of _closest() the closest of each root."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))] if len(rows) else rows


def _ends(x, y, far) -> np.ndarray:
    """(end): sets that may share 0.8 with one on the other side."""
    may = far <= 0
    return np.concatenate([x[0][may.any(axis=1)], y[0][may.any(axis=0)]])[:, None]


def _meetings(x, y, far) -> np.ndarray:
    """(x, y): blocks that hold sets which may share 0.8."""
    i, j = np.nonzero(far <= 0)
    return np.unique(np.stack([np.minimum(x[4][i], y[4][j]), np.maximum(x[4][i], y[4][j])], axis=1), axis=0)


def _across(sides: list[tuple[DataFrame, DataFrame]], sets: DataFrame, find, names: list[str]) -> DataFrame:
    """What find() makes of sets of unlike roots with a word in common: distinct rows of names, its last columns.

    A task holds a word's sets outside its largest group; those of the group pass by. find(x, y, slack) gets held
    sets and others, as arrays: ids, sizes, roots, bit sketches (bytes), blocks (0 where rooted has none). Of _closest()
    each root of a word has one row.
    """

    def run(batches):
        import pyarrow as pa

        at, held, out, ready, n = None, [], [], [], 0
        once = _first_of_root if find is _closest else partial(np.unique, axis=0)

        def near(rows):
            """Held sets meet rows that come with, or after, them."""
            whole = [np.concatenate(x) for x in zip(*held)]
            for low in range(0, len(whole[0]), 256):
                x = [c[low : low + 256] for c in whole]
                far = slack(x[1], rows[1], x[3], rows[3])
                far[x[2][:, None] == rows[2][None]] = _FAR
                out.append(find(x, rows, far))

        def settle():
            nonlocal n
            rows = out.pop()
            ready.append(rows[:, -len(names) :])
            n += len(rows)

        def told():
            nonlocal n
            rows, n = np.unique(np.concatenate(ready), axis=0), 0
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names))], names=names)

        for batch in batches:
            word, minor, *cols = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 6))
            bits = _objects(batch.column(5).to_pylist())
            edges = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (minor[1:] != minor[:-1]), [True]))) if len(word) else np.zeros(1, int)
            for low, high in zip(edges[:-1], edges[1:]):
                if word[low] != at:
                    if out:
                        settle()
                    if n > _HELD:
                        yield told()
                    at, held = word[low], []
                ids, size, root, block = (c[low:high] for c in cols)
                rows = ids, size, root, bits[low:high], block
                if minor[low]:
                    held.append(rows)
                if held:  # of a word's sets the main group's may be all that is left
                    near(rows)
                    out[:] = [once(np.concatenate(out))]
        if out:
            settle()
        if ready:
            yield told()

    found = []
    for rooted, top in sides:
        block = F.col("block") if "block" in rooted.columns else F.lit(0).cast("long")
        rows = rooted.join(top, F.col("word") == F.col("w")).select("word", (F.col("root") != F.col("main")).alias("minor"), "id", "root", block.alias("block"))
        rows = rows.join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("word", "minor", "id", "n", "root", "bits", "block")
        met = rows.repartition("word").sortWithinPartitions("word", F.desc("minor"))
        found.append(met.mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    return reduce(DataFrame.union, found).distinct()


def _placed(keyed: DataFrame, distinct: DataFrame, ends: DataFrame, family: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the sets ends (end), and (of, block) of each. family (node, root) brings them together in blocks."""
    placed = ends.join(family, F.col("end") == F.col("node"), "left").select("end", F.coalesce("root", "end").alias("family"))
    suspects = materialize(distinct.join(placed, F.col("id") == F.col("end")).select("id", "family", "low"), f"{name}_suspects")
    blocks = materialize(blocks_of(keyed, suspects), f"{name}_blocks")
    drop(suspects)
    return blocks, materialize(blocks.select(F.explode("ids").alias("of"), "block"), f"{name}_places")


def _met(over: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links within each of blocks, and between the pairs over (x, y) of them. Only blocks that meet another move."""
    far = over.filter("x != y")
    some = far.select(F.col("x").alias("meets")).union(far.select("y")).distinct()
    some = blocks.join(some, F.col("block") == F.col("meets"), "left_semi")
    return compare(None, blocks, _near).union(compare(far, some, _near)).filter("a != b")


def _verified(keyed: DataFrame, distinct: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(a, b): links among pairs (a, b) of sets, and whatever links their blocks show; pairs itself if it has no rows."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    blocks, where = _placed(keyed, distinct, ends, components(pairs), name)
    over = pairs.join(where.select(F.col("of").alias("a"), F.col("block").alias("x")), "a").join(where.select(F.col("of").alias("b"), F.col("block").alias("y")), "b")
    over = materialize(over.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), f"{name}_meet")
    found = materialize(_met(over, blocks), f"{name}_links")
    drop(blocks, where, over)
    return found


def _settled(keyed: DataFrame, distinct: DataFrame, sides: list[tuple[DataFrame, DataFrame]], sets: DataFrame, open_: DataFrame, name: str) -> DataFrame:
    """(a, b): links of all sets of sides that have unlike roots and may share 0.8. They meet as blocks; no pair of sets becomes a row.

    Chains of open_ (a, b), pairs that were near so far, bring them together in blocks.
    """
    ends = materialize(_across(sides, sets, _ends, ["end"]), f"{name}_ends")
    blocks, where = _placed(keyed, distinct, ends, components(open_), name)
    there = [(rooted.join(where, F.col("id") == F.col("of")).drop("of"), top) for rooted, top in sides]
    over = materialize(_across(there, sets, _meetings, ["x", "y"]), f"{name}_meet")
    found = materialize(_met(over, blocks), f"{name}_links")
    drop(ends, blocks, where, over)
    return found


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text).

    n_shingles is the number of different shingles of WIDTH words, A-Z lowered; a text of fewer words is one
    shingle, one without words or null has none. component_id is the smallest doc_id that links reach, the
    row's own included: sets link where 100 * common >= 80 * all, and no such pair is missed; equal sets are
    one. What has no shingle links with nothing. Rows that repeat a doc_id are nodes each, with their own text's
    links; a null doc_id counts only where a component has no other. No rows give no rows; columns beyond
    those named may be there and have any name. Shingles are compared by 64 bits of hash.
    """
    text = F.col("text").cast("binary")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256)).alias("digest"))
    keyed = docs.select(key.alias("key"), text.alias("text"))
    made = materialize(sketched(keyed), "jaccard_sets")
    distinct = made.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("low"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "jaccard_distinct")
    sets = distinct.select("id", "n", "bits")
    told = made.filter("size(words) > 0")
    words = _shared(told.select(F.explode(_firsts(F.col("n"), F.col("words"))).alias("word"), "d1", "d2"), distinct, "jaccard")

    # each word's sets meet the first of them
    star = materialize(_bounded(words.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets), "jaccard_star")
    found, near = _verified(keyed, distinct, star, "jaccard_star"), star

    # then each group of a word meets the closest set outside it; of two sets the first was one
    rest, joined, met = words.filter("k > 2"), None, None
    for k in range(ROUNDS + 1):
        roots = materialize(components(found), f"jaccard{k}_roots")
        before, joined = joined, roots.count()
        sides = _apart(rest, told, distinct, roots, f"jaccard{k}")
        if k == ROUNDS or (k and (met <= FEW or joined == before)):  # and what is apart even so, all with all
            found = found.union(_settled(keyed, distinct, sides, sets, near.union(found), f"jaccard{k}_rest"))
            met = 0
        else:
            close = materialize(_across(sides, sets, _closest, ["a", "b"]), f"jaccard{k}_close")
            met, near = close.count(), near.union(close)
            found = found.union(_verified(keyed, distinct, close, f"jaccard{k}_close"))
        drop(roots, *(t for side in sides for t in side))
        if not met:
            break
    drop(words)

    roots = components(found).withColumnRenamed("node", "linked")
    named = materialize(distinct.join(roots, F.col("id") == F.col("linked"), "left").select("d1", "d2", "low", F.coalesce("root", "id").alias("root")), "jaccard_named")
    # written before they are joined, so that Spark can split a large group's rows
    least = materialize(named.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("least")), "jaccard_least")
    sets = materialize(named.join(least, F.col("root") == F.col("of")).select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("least.id").alias("component_id")), "jaccard_ids")
    rows = made.select(F.col("key.id").alias("doc_id"), "d1", "d2", F.col("n").alias("n_shingles"))
    out = rows.join(sets, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
