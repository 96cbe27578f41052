"""Runs of words that repeat with a period, all of them, by the longest-previous-factor array of each text.

Ranks of 1, 2, 4, ... words from every place give the suffix array and, for any two places, how far they agree.
Walking the places backwards through the suffix array gives each one's longest previous factor, and these cut
the text into blocks, each a copy of something earlier. A run that touches the border of two blocks has a
period that their lengths bound: it is found by extending from the border both ways. Any other run lies inside
a block and is copied from where the block came from, in order of its start.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST = 12  # words of a run
_CORE = LEAST // 2  # words at least by which a run agrees with itself, a period further


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0 without gaps."""
    of = dict.fromkeys(words)
    for k, w in enumerate(of):
        of[w] = k
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def _may_repeat(ids: np.ndarray) -> bool:
    """Whether _CORE words in a row may occur twice, as they do in any run; equal ones have equal sums."""
    if len(ids) < LEAST:
        return False
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(len(ids) - _CORE + 1, np.uint64)
    for k in range(_CORE):
        sums = sums * np.uint64(0xD1342543DE82EF95) + (mixed[k : k + len(sums)] ^ (mixed[k : k + len(sums)] >> np.uint64(29)))
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


class Ranks:
    """Level k has the rank of the 2**k words from each place, cut at the end; at the last level all differ.

    Memory: four bytes a word and level, so 80 for a million words that repeat all along.
    """

    def __init__(self, ids: np.ndarray):
        self.n = n = len(ids)
        rank, width = ids, 1
        self.levels = [ids.astype(np.int32)]
        while rank.max() < n - 1:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.last = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree; i isn't j."""
        i, j, top = i.copy(), j.copy(), self.n - 1
        from_ = i.copy()
        for k in reversed(range(len(self.levels) - 1)):
            rank = self.levels[k]
            step = ((i <= top) & (j <= top) & (rank[np.minimum(i, top)] == rank[np.minimum(j, top)])).astype(np.int64) << k
            i += step
            j += step
        return i - from_

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words right before i and before j agree; i isn't j."""
        i, j = i.copy(), j.copy()
        from_ = i.copy()
        for k in reversed(range(len(self.levels) - 1)):
            rank, width = self.levels[k], 1 << k
            step = ((i >= width) & (j >= width) & (rank[np.maximum(i - width, 0)] == rank[np.maximum(j - width, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return from_ - i


def longest_previous(ranks: Ranks) -> tuple[list[int], list[int]]:
    """(length, place) of the longest factor from each place that also starts earlier; length 0 has no place."""
    n = ranks.n
    suffixes = np.empty(n, np.int64)
    suffixes[ranks.last] = np.arange(n)
    common = [0, *ranks.ahead(suffixes[:-1], suffixes[1:]).tolist(), 0]
    suffix, rank = suffixes.tolist(), ranks.last.tolist()
    # a list of the suffixes that start at or before i: the last one goes, and its neighbours meet
    less, more = list(range(-1, n)), list(range(1, n + 1))
    length, place = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = less[r], more[r]
        up, down = common[r], common[b]
        if up >= down:
            if up:
                length[i], place[i] = up, suffix[a]
        else:
            length[i], place[i] = down, suffix[b]
            common[b] = up
        if a >= 0:
            more[a] = b
        less[b] = a
    return length, place


def blocks(length: list[int], place: list[int]) -> list[tuple[int, int, int]]:
    """(start, size, source) of the blocks, source -1 for a word that is new."""
    out, at = [], 0
    while at < len(length):
        size = length[at] or 1
        out.append((at, size, place[at]))
        at += size
    return out


def _at_borders(ranks: Ranks, cut: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Sorted (start, end, period) of the runs that touch the border of two blocks, or the end.

    Of a border between blocks of a and c words: a run that ends in the second block and reaches a period
    beyond the border has a period of c at most; one that reaches a period before it less than a + c, as else
    the first block would have been longer.
    """
    size = np.array([*(s for _, s, _ in cut), 0], np.int64)
    border = np.cumsum(size[:-1])
    a, c = size[:-1], size[1:]

    def places(n):
        """Each border with the periods 1..n."""
        b = np.repeat(border, n)
        return b, np.arange(1, len(b) + 1) - np.repeat(np.cumsum(n) - n, n)

    b1, p1 = places(c)
    b2, p2 = places(np.minimum(a + c - 1, border))
    i, j = np.concatenate([b1, b2 - p2]), np.concatenate([b1 + p1, b2])
    two, top = ranks.levels[1], ranks.n - 1  # a run agrees with itself for _CORE words, so two of them on either side
    near = (j <= top) & (two[np.minimum(i, top)] == two[np.minimum(j, top)])
    near |= (i >= 2) & (two[np.maximum(i - 2, 0)] == two[np.maximum(j - 2, 0)])
    i, j = i[near], j[near]
    left, right = ranks.behind(i, j), ranks.ahead(i, j)
    whole = (left + right >= j - i) & (left + right + j - i >= least)
    start, end, period = (i - left)[whole], (j + right)[whole], (j - i)[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of multiples of a period the least
    return list(zip(start[first].tolist(), end[first].tolist(), period[first].tolist()))


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of LEAST words or more, by start and period; ids from numbered()."""
    if not _may_repeat(ids):
        return []
    ranks = Ranks(ids)
    if len(ranks.levels) < 2:
        return []
    cut = blocks(*longest_previous(ranks))
    known = _at_borders(ranks, cut, LEAST)
    for at, size, source in cut:
        if size < LEAST + 2:
            continue
        k = bisect_right(known, (source, ranks.n + 1))
        while k < len(known) and known[k][0] < source + size - LEAST:
            start, end, period = known[k]
            if end < source + size:  # copies of a block over itself come up later in this loop
                insort(known, (start + at - source, end + at - source, period))
            k += 1
    return sorted(known, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: each run's first period stays."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, end, period in found:
        change[start + period] += 1
        change[end] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, s in zip(words, stays.tolist()) if s])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) per row of docs (doc_id, text); no rows give no rows.

    runs has start (word number from 0), length (words) and period, by start and period, of every stretch of
    LEAST words or more and two periods or more that no neighbouring word extends; its period is the smallest.
    Words are what stands between ASCII white space. collapsed is the text without what runs repeat after
    their first period. A null or empty text has no run and an empty collapsed text; repeated rows and null
    ids keep a row each; columns beyond those named may be there and have any name.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ends, flat, texts = [0], [], []
            for text in b.column(1).to_pylist():
                words = (text or b"").split()
                found = runs(numbered(words))
                flat += found
                ends.append(len(flat))
                texts.append(collapsed(words, found))
            cols = np.array(flat, np.int64).reshape(-1, 3)
            fields = {"start": cols[:, 0], "length": cols[:, 1] - cols[:, 0], "period": cols[:, 2]}
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in fields.values()], names=list(fields))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(texts, pa.binary())], names=["doc_id", "runs", "collapsed"])

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = narrow.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with every tenth text, by the CRC32 of its id, made periodic from some word on; a null id's isn't."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    due = d.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    due = due.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    again = F.transform(F.sequence(F.col("a"), F.col("n").cast("long") - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a").cast("int")), again)
    return due.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # the greatest length, then the smallest start and period
    order = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    best = F.array_min(order)
    found = found.withColumn("best", best)
    length, start, period = -F.col("best.col1"), F.col("best.start"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
