"""Exact top-k inner products with vector-approximation files.

Every vector is kept twice: as one byte a component (the cell of an even grid it lies in), and exactly.
Cells bound all scores; exact vectors are read only where a bound leaves a place among the best open, in
the bounds' order, until the kth result is certain.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialize, opened, root

CELLS = 256
SLAB = 16384  # vectors of one file
GROUP = 4096  # queries that a task holds
UNITS = 1024  # pieces of work (a group of queries over some of the slabs), or one a group if there are more groups
SCAN = 256  # queries bounded at once
ENDS = 2.0**63  # of scores


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each x, held within a long: Spark's floor() stops at its ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


class Grid:
    """Cells of equal width from low to high."""

    def __init__(self, low: int, high: int, dims: int):
        self.low, self.high, self.dims = min(low, 0), max(high, 0), dims  # shorter vectors end in zeros
        self.width = max(1, -(-(self.high - self.low + 1) // CELLS))
        self.half = (self.width - 1) / 2
        self.kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= self.low and self.high <= np.iinfo(k).max)
        most = max(-self.low, self.high)
        self.wide = dims * most * most >= 1 << 62  # then scores are computed with Python's integers

    def cells(self, v: np.ndarray) -> np.ndarray:
        up = v.astype(np.int64).view(np.uint64) - np.uint64(self.low % (1 << 64))  # differences wrap to what they are
        return (up // np.uint64(self.width)).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return cells * float(self.width) + (self.low + self.half)

    def slack(self, q: np.ndarray) -> np.ndarray:
        """How far a score can be from the one with the cells' middles, rounding included."""
        size = np.abs(q.astype(np.float64)).sum(axis=1)
        return size * self.half + size * max(-self.low, self.high) * 2.0**-40

    def dot(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.wide:
            ends = np.iinfo(np.int64)
            return np.array([min(max(x, ends.min), ends.max) for x in (rows.astype(object) @ q.astype(object)).tolist()], np.int64)
        return rows.astype(np.int64) @ q.astype(np.int64)


def write_files(vectors: DataFrame, folder: str, grid: Grid, most: int) -> DataFrame:
    """Files of at most `most` vectors (vec_id, v) each; returns (name, n)."""

    def run(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        ids, rows, names, sizes = [], [], [], []

        def flush():
            name = uuid.uuid4().hex
            v = np.concatenate(rows)
            order = np.argsort(np.array(ids), kind="stable")
            for kind, data in (("ids", np.array(ids, np.int64)[order]), ("cells", grid.cells(v[order])), ("exact", v[order])):
                with fs.open_output_stream(f"{base}/{name}.{kind}", compression=None) as f:
                    f.write(data.tobytes())
            names.append(name)
            sizes.append(len(ids))
            ids.clear()
            rows.clear()

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                lists = part.column(1).to_pylist()
                v = np.zeros((len(lists), grid.dims), grid.kind)
                for k, x in enumerate(lists):
                    v[k, : len(x)] = x
                while len(v):
                    take = min(len(v), most - len(ids))
                    ids.extend(part.column(0).to_pylist()[part.num_rows - len(v) :][:take])
                    rows.append(v[:take])
                    v = v[take:]
                    if len(ids) == most:
                        flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "n"])

    return materialize(vectors.mapInArrow(run, "name string, n long"), "va_files")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_slab(grid: Grid, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, cells: np.ndarray, exact, best: list, k: int) -> None:
    """Updates best (per query: scores, ids) with a slab; exact(places) reads exact vectors of sorted places."""
    middles, slack = grid.middles(cells), grid.slack(q)
    for at in range(0, len(q), SCAN):
        upper = q[at : at + SCAN].astype(np.float64) @ middles.T + slack[at : at + SCAN, None]
        low, high = np.searchsorted(ids, q_ids[at : at + SCAN], "left"), np.searchsorted(ids, q_ids[at : at + SCAN], "right")
        for i, (a, z) in enumerate(zip(low, high)):
            upper[i, a:z] = -np.inf
        if upper.shape[1] > k:
            certain = np.partition(upper, upper.shape[1] - k, axis=1)[:, -k] - 2 * slack[at : at + SCAN]
        else:
            certain = np.full(len(upper), -np.inf)
        known = np.array([b[0][-1] if len(b[0]) == k else -np.inf for b in best[at : at + SCAN]], np.float64)
        upper = np.where(upper == -np.inf, upper, np.clip(upper, -ENDS, ENDS))  # as scores stop there, too
        floor = np.maximum(np.clip(certain, None, ENDS), known - np.abs(known) * 2.0**-50)
        opens = (upper >= floor[:, None]) & (upper > -np.inf)
        places = np.flatnonzero(opens.any(axis=0))
        if not len(places):
            continue
        rows = exact(places)
        for i in range(len(upper)):
            mine = np.flatnonzero(opens[i, places])
            if not len(mine):
                continue
            bound = upper[i, places[mine]]
            order = np.argsort(-bound, kind="stable")
            scores, found = best[at + i]
            step = 8 * k
            for s in range(0, len(order), step):
                if len(scores) == k and bound[order[s]] < float(scores[-1]) - abs(float(scores[-1])) * 2.0**-50:
                    break  # no further vector can reach the kth score
                take = mine[order[s : s + step]]
                scores = np.concatenate([scores, grid.dot(rows[take], q[at + i])])
                found = np.concatenate([found, ids[places[take]]])
                top = best_of(scores, found, k)
                scores, found = scores[top], found[top]
            best[at + i] = scores, found


def write_lists(slabs: DataFrame, folder: str) -> DataFrame:
    """(run, file): a file of folder per run of slabs (name, n, run), with a line a slab; read line by line, whatever their number."""

    def write(batches):
        import pyarrow as pa

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, runs, files = None, [], []
        try:
            for b in batches:
                for name, n, run in zip(*(c.to_pylist() for c in b.columns)):
                    if not runs or run != runs[-1]:
                        if out is not None:
                            out.close()
                        runs.append(run)
                        files.append(f"{uuid.uuid4().hex}.list")
                        out = fs.open_output_stream(f"{base}/{files[-1]}", compression=None)
                    out.write(f"{name}\t{n}\n".encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(files, pa.string())], names=["run", "file"])

    rows = slabs.select("name", "n", "run").repartition("run").sortWithinPartitions("run")
    return materialize(rows.mapInArrow(write, "run long, file string"), "va_lists")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, the k best of all other rows.

    vectors has vec_id and embedding. Rows whose vector is null or holds a null or non-finite component, or
    whose vec_id is null, take no part. A shorter vector counts as if zeros followed; an empty one scores 0
    everywhere. Equal scores go to smaller ids. Rows that repeat a vec_id are candidates and queries each,
    and none is a candidate of its own id; no rows, or no query, give no rows. Scores beyond a long are its ends. Queries go over files in blocks;
    a task holds GROUP queries and one slab, and its result is the k best of all slabs of its piece of work.
    There are UNITS pieces, or as many as groups: so results grow with the queries, not with the pairs.
    """
    spark = vectors.sparkSession
    v = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"))
    asked = F.col("vec_id") % every == 0
    said = v.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max(F.size("v")).alias("dims"), F.count_if(asked).alias("asked")).first()
    grid = Grid(said["low"] or 0, said["high"] or 0, said["dims"] or 1)
    folder = f"{root(spark)}/va"
    slabs = write_files(v, folder, grid, SLAB)
    groups = write_files(v.filter(asked).repartition(max(1, -(-said["asked"] // GROUP))), folder, grid, GROUP)
    runs = -(-UNITS // max(1, groups.count()))
    lists = write_lists(slabs.withColumn("run", F.pmod(F.xxhash64("name"), F.lit(runs))), folder)
    lists = {r["run"]: r["file"] for r in lists.collect()}  # UNITS at most
    units = groups.withColumn("g", F.monotonically_increasing_id()).select("g", "name", "n", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(batches):
        import pyarrow as pa

        fs, base = opened(folder)

        def load(name, kind, dtype, n):
            with fs.open_input_file(f"{base}/{name}.{kind}") as f:
                data = np.frombuffer(f.read(), dtype)
            return data if kind == "ids" else data.reshape(n, grid.dims)

        def reader(name, n):
            file, wide = fs.open_input_file(f"{base}/{name}.exact"), grid.dims * np.dtype(grid.kind).itemsize

            def rows(places):
                if 4 * len(places) >= n:
                    return np.frombuffer(file.read_at(n * wide, 0), grid.kind).reshape(n, grid.dims)[places]
                cuts = np.flatnonzero(np.diff(places) > 16) + 1  # places nearer than that are read together
                out = []
                for part in np.split(places, cuts):
                    got = np.frombuffer(file.read_at((part[-1] - part[0] + 1) * wide, part[0] * wide), grid.kind).reshape(-1, grid.dims)
                    out.append(got[part - part[0]])
                return np.concatenate(out)

            return rows, file

        def slabs_of(run):
            if run in lists:
                with fs.open_input_stream(f"{base}/{lists[run]}", compression=None) as f:
                    for line in io.TextIOWrapper(io.BufferedReader(f)):
                        name, n = line.split("\t")
                        yield name, int(n)

        for b in batches:
            for g, name, count, run in zip(*(c.to_pylist() for c in b.columns)):
                q_ids, q = load(name, "ids", np.int64, count), load(name, "exact", grid.kind, count)
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * count
                for slab, size in slabs_of(run):
                    exact, file = reader(slab, size)
                    with file:
                        search_slab(grid, q, q_ids, load(slab, "ids", np.int64, size), load(slab, "cells", np.uint8, size), exact, best, k)
                sizes = [len(x[0]) for x in best]
                place = np.repeat(np.arange(count), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), g, np.int64)), pa.array(place), pa.array(q_ids[place]), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))],
                    names=["g", "place", "query_id", "vec_id", "score"],
                )

    found = units.repartition(n).mapInArrow(search, "g long, place long, query_id long, vec_id long, score long")
    order = W.partitionBy("g", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
