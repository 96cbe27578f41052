"""Best-fit packing of documents into sequences by a linear grouping scheme.

Only counts by length are planned with, so the plan's size depends on the sequence length and never on
the number of documents: large lengths are rounded up within groups of equal cardinality, configurations
of the few rounded sizes are filled in turn, actual lengths take the places of the rounded ones, and
small lengths go where they fit best. Documents then find their places by their rank within a length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import materialize

CAPACITY = 2048
GROUPS = 1024  # sequences at sf0.1 by groups, where tokens alone need 4936: 8: 4962, 64: 4959, 128: 4947, 1024: 4937
SMALL = 4  # lengths up to capacity // SMALL are small


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, part, nth.

    A document is its ids and one end id. A longer one than capacity is cut so that all pieces but the
    first are full. part is the task, nth the number of earlier pieces of that length in it.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .pretokens import byte_coder

        coder, part, seen = byte_coder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        last = end.to_bytes(4, "little")
        for b in batches:
            of, cols = [], [[] for _ in range(5)]
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview((coder.ids(text.decode()) if text else b"") + last)
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    of.append(k)
                    for c, v in zip(cols, (piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), seen[length])):
                        c.append(v)
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([part] * len(of), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"],
            )

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int")


def grouped(counts: np.ndarray, smallest: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)]) of equal cardinality for lengths of smallest and more, longest first."""
    total = int(counts[smallest:].sum())
    each = max(1, -(-total // groups))
    out, room = [], 0
    for s in range(len(counts) - 1, smallest - 1, -1):
        left = int(counts[s])
        while left:
            if not room:
                out.append((s, []))
                room = each
            n = min(left, room)
            out[-1][1].append((s, n))
            left, room = left - n, room - n
    return out


def fullest(sizes: list[int], have: list[int], capacity: int) -> list[tuple[int, int]]:
    """(index, times) of a configuration that is as full as sizes can make it, the largest size in it first.

    Bounded subset sums by bit sets: reach[k] holds the sums that sizes k.. can make.
    """
    first = next(k for k, n in enumerate(have) if n)
    room = capacity - sizes[first]
    reach, mask = [1] * (len(sizes) + 1), (1 << room + 1) - 1
    for k in range(len(sizes) - 1, first - 1, -1):
        r, n, step = reach[k + 1], have[k] - (k == first), 1
        n = min(n, room // sizes[k])
        while n > 0:
            t = min(step, n)
            r |= r << t * sizes[k] & mask
            n, step = n - t, step * 2
        reach[k] = r
    best, config = reach[first].bit_length() - 1, {first: 1}
    for k in range(first, len(sizes)):
        while best and not reach[k + 1] >> best & 1:  # this size is needed
            config[k] = config.get(k, 0) + 1
            best -= sizes[k]
    return sorted(config.items())


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): ranks of a length go to sequences in order.

    counts[s] is the number of pieces of length s. At most capacity + 1 lengths come in and every step
    works on runs of equal sequences.
    """
    counts = np.asarray(counts, np.int64).copy()
    smallest = capacity // small + 1
    given = np.zeros(capacity + 1, np.int64)  # ranks given out by length
    rows: list[tuple[int, int, int, int, int]] = []
    runs: list[tuple[int, int, int]] = []  # (slack, first sequence, count), sorted
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, int(given[length]), n, first, offset))
        given[length] += n

    if counts[capacity]:
        put(capacity, int(counts[capacity]), 0, 0)
        sequences = int(counts[capacity])
    kept = counts.copy()
    kept[capacity] = 0
    rounded = grouped(kept, smallest, groups)
    # groups of one rounded size are one size with their members in order
    sizes, members = [], []
    for size, inside in rounded:
        if sizes and sizes[-1] == size:
            members[-1].extend(inside)
        else:
            sizes.append(size)
            members.append(list(inside))
    have = [sum(n for _, n in m) for m in members]
    while any(have):
        config = fullest(sizes, have, capacity)
        times = min(have[k] // t for k, t in config)
        slots = [k for k, t in config for _ in range(t)]
        for k, t in config:
            have[k] -= t * times
        # actual lengths take the slots; sequences between two changes of length are alike
        lanes = []
        for k in slots:
            lane, need = [], times
            while need:
                s, n = members[k][0]
                m = min(n, need)
                lane.append((s, m))
                members[k][0] = (s, n - m)
                if n == m:
                    members[k].pop(0)
                need -= m
            lanes.append(lane)
        at = 0
        while at < times:
            n = min(lane[0][1] for lane in lanes)
            offset = 0
            for lane in lanes:
                s, m = lane[0]
                put(s, n, sequences + at, offset)
                offset += s
                lane[0] = (s, m - n)
                if m == n:
                    lane.pop(0)
            bisect.insort(runs, (capacity - offset, sequences + at, n))
            at += n
        sequences += times
    for s in range(smallest - 1, 0, -1):
        left = int(counts[s])
        while left:
            k = bisect.bisect_left(runs, (s,))
            if k < len(runs):
                slack, first, n = runs.pop(k)
            else:
                slack, first, n = capacity, sequences, -(-left // (capacity // s))
                sequences += n
            m = min(n, left)
            put(s, m, first, capacity - slack)
            left -= m
            if slack > s:
                bisect.insort(runs, (slack - s, first, m))
            if n > m:
                bisect.insort(runs, (slack, first + m, n - m))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of docs (doc_id, text).

    A null or empty text is its end id alone. Repeated rows are packed each; null ids stay null; no rows give no rows. The
    counts by length (at most capacity rows) reach the driver, and the plan made of them every task.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity), "pack_pieces")
    by_part = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "pack_counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    table = plan(counts, capacity, groups)
    table = table[np.lexsort((table[:, 1], table[:, 0]))] if len(table) else table
    base = np.concatenate(([0], np.cumsum(counts)))  # ranks over all lengths, so that one search finds a row
    starts = base[table[:, 0]] + table[:, 1]
    shared = spark.sparkContext.broadcast((table, starts, base))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    by_length = F.map_from_entries(F.collect_list(F.struct("length", "before")))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(capacity).cast("long")), lambda k: F.element_at("known", k))
    offsets = offsets.groupBy("part").agg(by_length.alias("known")).select(F.col("part").alias("p"), dense.alias("before"))
    offsets = materialize(offsets, "pack_offsets")  # a row for each part; never broadcast, as parts grow with the input
    ranked = cut.join(offsets.hint("merge"), F.col("part") == F.col("p"))
    rank = F.element_at("before", (F.col("length") + 1).cast("int")) + F.col("nth")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank.alias("rank"))

    def place(batches):
        import pyarrow as pa

        table, starts, base = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(starts, base[length] + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(table[k, 3] + rank - table[k, 1]), pa.array(table[k, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
