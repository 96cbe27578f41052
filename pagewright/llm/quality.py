"""Quality scores of a small byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK, STEP = 512, 448  # bytes of a chunk, and from one chunk's start to the next's
CELL = 4  # bytes from one filter position to the next; a filter sees two cells
WIDTH, FILTERS = 8, 32
SAMPLE = 2400  # labelled documents that a fit reads at most
AT_ONCE = 256  # chunks in memory as numbers
STEPS = 500  # of a fit, in batches of documents, but EPOCHS (least and most) times each document
EPOCHS = (8, 24)


def chunks(text: bytes) -> np.ndarray:
    """All overlapping chunks of a text, one at least; the last ends with the text. Zeros fill up a short text."""
    raw = np.zeros(max(CHUNK, len(text)), np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    whole = np.lib.stride_tricks.sliding_window_view(raw, CHUNK)
    last = len(raw) - CHUNK
    starts = np.arange(0, last, STEP) if last else np.zeros(0, int)
    return whole[np.append(starts, last)]


class Network:
    """Bytes -> embedding -> filters over pairs of cells -> maximum of each chunk -> its maximum, mean and minimum over chunks -> probability."""

    def __init__(self, seed: int = 7, prior: float | None = None):
        rng = np.random.default_rng(seed)
        self.prior = prior  # the answer for all, where there was nothing to learn from
        self.emb = rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32)
        self.w = rng.normal(0, (2 * CELL * WIDTH) ** -0.5, (2 * CELL * WIDTH, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = np.zeros(3 * FILTERS, np.float32)
        self.c = np.zeros(1, np.float32)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters) of chunks of bytes."""
        half = CELL * WIDTH
        cells = np.take(self.emb, x.reshape(-1), axis=0).reshape(-1, half)
        both = (cells @ np.hstack([self.w[:half], self.w[half:]])).reshape(len(x), CHUNK // CELL, 2 * FILTERS)  # one product for both cells of a filter
        return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def pooled(self, x: np.ndarray, places: bool = False):
        """(chunks, filters): each filter's highest response in a chunk, at least 0; with places also the raw ones and where they are."""
        raw, where = [], []
        for at in range(0, len(x), AT_ONCE):
            r = self.responses(x[at : at + AT_ONCE])
            if places:
                where.append(r.argmax(axis=1))
                raw.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0] + self.b)
            else:
                raw.append(r.max(axis=1) + self.b)
        raw = np.concatenate(raw)
        return (np.maximum(raw, 0), raw, np.concatenate(where)) if places else np.maximum(raw, 0)

    def probability(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(starts, len(pooled)))[:, None]
        f = np.hstack([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / n, np.minimum.reduceat(pooled, starts)])
        return 1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -30, 30).astype(np.float64)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        pooled, starts, waiting, count, total = [], [], [], 0, 0
        for t in texts:
            x = chunks(t)
            starts.append(total)
            total += len(x)
            waiting.append(x)
            count += len(x)
            if count >= AT_ONCE:
                pooled.extend(map(self.pooled, waiting) if len(waiting) == 1 else [self.pooled(np.concatenate(waiting))])
                waiting, count = [], 0
        if waiting:
            pooled.append(self.pooled(np.concatenate(waiting)))
        return self.probability(np.concatenate(pooled), np.array(starts)) if texts else np.zeros(0)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, self.w, self.b, self.v, self.c]

    def gradients(self, xs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over documents, plus 1e-4 of half the square of v, by parameters(). xs: all chunks of each document."""
        n = np.array([len(x) for x in xs])
        x, starts, doc = np.concatenate(xs), np.cumsum(n) - n, np.repeat(np.arange(len(xs)), n)
        p, raw, where = self.pooled(x, places=True)
        top, low = np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)
        f = np.hstack([top, np.add.reduceat(p, starts) / n[:, None], low])
        z = np.clip(f @ self.v + self.c, -30, 30)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(xs)).astype(np.float32)
        df = dz[:, None] * self.v
        dp = df[doc, FILTERS : 2 * FILTERS] / n[doc][:, None]
        for at, best in ((slice(0, FILTERS), top), (slice(2 * FILTERS, None), low)):
            hit = p == best[doc]
            dp += df[doc, at] * hit / np.add.reduceat(hit.astype(np.float32), starts)[doc]  # equal ones share it
        dp = np.where(raw > 0, dp, 0).astype(np.float32)
        dw, demb = np.zeros_like(self.w), np.zeros_like(self.emb)
        for at in range(0, len(x), AT_ONCE):
            part, d = x[at : at + AT_ONCE], dp[at : at + AT_ONCE]
            seen = part[np.arange(len(part))[:, None, None], where[at : at + AT_ONCE, :, None] * CELL + np.arange(2 * CELL)]  # chunk, filter, byte
            e = self.emb[seen].reshape(len(part), FILTERS, 2 * CELL * WIDTH)
            dw += np.einsum("cf,cfk->kf", d, e)
            de = (d[:, :, None] * self.w.T[None]).reshape(-1, WIDTH)
            demb += np.stack([np.bincount(seen.reshape(-1), de[:, k], 256) for k in range(WIDTH)], 1).astype(np.float32)
        return [demb, dw, dp.sum(axis=0), f.T @ dz + 1e-4 * self.v, dz.sum(keepdims=True)]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int | None = None, batch: int = 48, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over batches of whole texts; y: their labels. Only one batch's chunks are in memory."""
        epochs = epochs or min(max(-(-STEPS // -(-len(y) // batch)), EPOCHS[0]), EPOCHS[1])
        rng, params = np.random.default_rng(seed), self.parameters()
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at : at + batch]
                t += 1
                step = rate * min(1, 2 * (1 - t / (steps + 1)))
                for i, g in enumerate(self.gradients([chunks(texts[d]) for d in docs], y[docs])):
                    m[i] += 0.1 * (g - m[i])
                    s[i] += 0.01 * (g * g - s[i])
                    params[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-7)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network that has learned labels (doc_id, quality) of rows that are not held out.

    It reads at most `sample` labelled documents, taken by a hash of doc_id, but all of each: the driver
    holds their texts. A doc_id that labels repeat counts with the larger label, one that docs repeat with
    its least text, so reruns agree; null ids and labels teach nothing, a null text is an empty one. With
    no label, or one kind only, it answers the share of ones (0.5 with none) for every text.
    """
    ids = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    taught = texts.join(F.broadcast(ids), F.col("id") == F.col("doc_id"))  # at most `sample` rows
    rows = taught.groupBy("id", "y").agg(F.min("text").cast("binary").alias("text")).collect()
    rows.sort(key=lambda r: r["id"])
    y = np.array([min(1, max(0, r["y"])) for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return Network(prior=float(y.mean()) if len(y) else 0.5)
    net = Network()
    net.fit([bytes(r["text"]) for r in rows], y)
    return net


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """(row struct, score double) per row of docs (text, more columns of any names): 0 to 1 for the whole text, null and empty ones too.

    A null text scores as an empty one. Repeated rows come back each, no rows give none.
    """
    at = docs.columns.index("text")
    flat = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = net.scores([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    schema = StructType([*flat.schema.fields, StructField("score", DoubleType())])
    row = F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return flat.mapInArrow(run, schema).select(row.alias("row"), "score")


def op6_quality_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select("doc_id", "text"), net)
    doc_id, score = F.col("row.doc_id"), F.col("score")
    return scored.select(doc_id, held_out(doc_id).alias("held_out"), "score", (score >= 0.5).cast("int").alias("predicted"))
