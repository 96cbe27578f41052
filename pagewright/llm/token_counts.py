"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LIMIT = 2048


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs (doc_id, text).

    vocabulary is the tokenizer file's path on every executor. Strings of special tokens inside a text
    count as the library's default counts them: one token each. A null text is an empty one: 0 bytes and
    0 tokens. Repeated rows are counted each; null ids stay null; no rows give no rows. No shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        from .pretokens import word_counter

        counter = word_counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            tokens = pa.array([counter.count(t.decode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, tokens], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
