"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
FILLS = 6  # times that later documents fill up a source whose boundary document is too long


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def stable_hash(key: Column) -> Column:
    """60 bits of MD5 of the key as text: the same on every run and in other engines."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """One row per source: source_size and target words.

    sizes has one row per source (source, source_size). Weights repeat over the sources in code point
    order, null last. A target stops at max_repeat times its source's size and the excess goes to the
    others by weight; sorted by cap/weight, the capped sources are a prefix, so running sums find them.
    These windows run over one small row per source, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    s = (
        sizes.withColumn("w", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("pool", F.floor(F.sum("source_size").over(every) * F.lit(share)).cast("long"))
    )
    by_ratio = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    fits = wide(F.col("cap")) * wide(F.sum("w").over(every) - earlier("w")) <= wide(F.col("pool") - earlier("cap")) * wide(F.col("w"))
    s = s.withColumn("fits", fits).withColumn("capped", F.min("fits").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("rest", F.col("pool") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    s = s.withColumn("rest_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("rest") * F.col("w")).cast("double") / F.col("rest_w").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _edges(narrow: DataFrame, state: DataFrame, name: str) -> tuple[int, DataFrame]:
    """Adds per source with eligible rows the boundary of its budget: used (words below), edge (hash), words (at it); their number comes first.

    narrow has (source, size, h), state (source, budget, more). Each level sums words by source and the next
    LEVEL_BITS of the hash, inside the boundary bucket of the level before; it ends when every boundary
    bucket holds a single hash. Where all words fit, the boundary is the last hash.
    """
    kept = state.columns
    state = state.withColumns({"used": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long")})
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = narrow
        if level > 1:
            at = state.select(F.col("source").alias("at_source"), F.col("prefix").alias("at"))
            inside = narrow.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("at")), "left_semi")
        bucket = F.shiftright("h", shift)
        hist = inside.groupBy(F.col("source").alias("of"), bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        joined = hist.join(state.select(*kept, "used"), F.col("of").eqNullSafe(F.col("source")))
        run = W.partitionBy("source").orderBy("bucket")
        joined = joined.withColumn("upto", F.col("used") + F.sum("words").over(run)).withColumn("last", F.lead("bucket").over(run).isNull())
        pick = joined.filter((F.col("upto") > F.col("budget")) | F.col("last"))
        pick = pick.withColumn("n", F.row_number().over(run)).filter("n = 1")
        state = pick.select(*kept, (F.col("upto") - F.col("words")).alias("used"), F.col("bucket").alias("prefix"), "words", "low", "high")
        state = materialize(state, f"{name}_level{level}")
        said = state.agg(F.count("*").alias("sources"), F.count_if(F.col("low") < F.col("high")).alias("wide")).first()
        if not said["wide"]:
            break
    return said["sources"], state.select(*kept, "used", F.col("high").alias("edge"), "words")


def _thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds per source: full (copies that all its rows get), edge (hash), at_edge (whether that hash gets a copy more), fills.

    A long document at the boundary may leave a source short. Then later documents that still fit are taken
    in the order of their hash, FILLS times at most, each time past the first that doesn't fit; fills has
    (after, upto, most): hashes above after and up to upto with up to most words get a copy more. The
    boundary gets one instead if that leaves the source nearer to its target.
    """
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = targets.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * size)
    _, state = _edges(narrow, state, "mix")
    fits = F.col("used") + F.col("words") <= F.col("budget")
    rest = F.col("budget") - F.col("used") - F.when(fits, F.col("words")).otherwise(0)
    none = F.array().cast("array<struct<after:bigint,upto:bigint,most:bigint>>")
    state = state.select("source", "source_size", "target", "full", "edge", fits.alias("fits"), (F.col("used") + F.col("words") - F.col("budget")).alias("over"), rest.alias("rest"), none.alias("fills"), F.col("edge").alias("after"))
    state = materialize(state, "mix_edges")
    for k in range(FILLS):
        open_ = state.filter("NOT fits AND rest > target / 1000")
        at = open_.select(F.col("source").alias("at_source"), "after", F.floor("rest").cast("long").alias("most"))
        # fills end soon: a hash that didn't fit is passed over, and what fits is smaller each time
        some = narrow.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("h") > F.col("after")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0)).select("source", "size", "h")
        sources, found = _edges(some, open_.select("source", F.col("rest").alias("budget")), f"mix_fill{k}")
        if not sources:
            break
        in_ = F.col("used") + F.col("words") <= F.col("budget")
        found = found.select(F.col("source").alias("of"), F.when(in_, F.col("edge")).otherwise(F.col("edge") - 1).alias("upto"), F.col("edge").alias("to"), (F.col("used") + F.when(in_, F.col("words")).otherwise(0)).alias("got"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        more = F.concat("fills", F.array(F.struct("after", "upto", F.floor("rest").cast("long").alias("most"))))
        state = joined.select(
            "source", "source_size", "target", "full", "edge", "fits", "over", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("rest"),
            F.when(F.col("of").isNotNull() | F.col("to").isNotNull(), more).otherwise(F.col("fills")).alias("fills"), F.coalesce("to", "after").alias("after"),
        )
        state = materialize(state, f"mix_filled{k}")
    at_edge = F.col("fits") | (F.col("over") < F.col("rest"))
    return state.select("source", "source_size", "target", "full", "edge", at_edge.alias("at_edge"), F.when(F.col("fits") | ~at_edge, F.col("fills")).otherwise(none).alias("fills"))


def _copies(size: Column) -> Column:
    h = F.col("h")
    fill = F.exists("fills", lambda f: (h > f["after"]) & (h <= f["upto"]) & (size <= f["most"]) & (size > 0))
    return F.col("full") + ((h < F.col("edge")) | ((h == F.col("edge")) & F.col("at_edge")) | fill).cast("long")


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) per document, and a row per source with its target and threshold."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), stable_hash(F.col("doc_id")).alias("h"))
    narrow = materialize(narrow, "mix_sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, max_repeat), "mix_targets")
    return narrow, _thresholds(narrow, targets).withColumnRenamed("source", "of")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Per document of docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, source.

    A source's rows all get floor(target / source_size) copies; those whose hash is below the source's
    threshold get one more. Where the document at the threshold is too long, later ones fill up what is
    left, or it gets its copy too if that leaves the source nearer to its target. Rows that repeat a
    doc_id share its hash and so its decision. A null text has size 0 and takes 0; null sources are one
    source, in last place; no rows give no rows.
    """
    narrow, edges = _planned(docs, weights, share, max_repeat)
    out = narrow.join(edges, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("size"))).alias("taken"), _copies(F.col("size")).alias("copies"), "source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """docs with each row as often as mix() takes it, its columns as they are. Only thresholds are joined, so no text moves for it.

    Null ids share one hash, a null text counts no words, null sources are one source; no rows give no rows.
    """
    _, edges = _planned(docs, weights, share, max_repeat)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs can clash
    rows = docs.select(whole, stable_hash(F.col("doc_id")).alias("h"))
    out = rows.join(edges, F.col("row.source").eqNullSafe(F.col("of")))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), _copies(word_count(F.col("row.text"))).cast("int")))).select("row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, source_size, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS pool,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
f AS (
  SELECT *, cap::HUGEINT * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (pool - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * w AS fits
  FROM s),
c AS (SELECT *, bool_and(fits) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM f),
r AS (
  SELECT *, (pool - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS rest,
         (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS rest_w
  FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (rest * w)::DOUBLE / rest_w::DOUBLE END AS target FROM r),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
run AS (
  SELECT d.doc_id, d.source, d.size, d.h, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
first AS (
  SELECT source, target, budget, coalesce(min(h) FILTER (upto > budget), max(h)) AS edge, coalesce(bool_and(upto <= budget), true) AS fits,
         budget - coalesce(max(upto) FILTER (upto <= budget), 0) AS rest, min(upto) FILTER (upto > budget) - budget AS over
  FROM run GROUP BY source, target, budget),
s0 AS (SELECT source, target, edge, fits, over, edge AS after, rest FROM first),
@FILLS@
taken AS (SELECT DISTINCT doc_id, source, h, size FROM (@TAKEN@))
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (whole + CASE WHEN r.h < e.edge OR (r.h = e.edge AND (e.fits OR e.over < e.rest)) OR (NOT (NOT e.fits AND e.over < e.rest) AND t.h IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run r JOIN s@LAST@ e ON r.source IS NOT DISTINCT FROM e.source
LEFT JOIN taken t ON r.source IS NOT DISTINCT FROM t.source AND r.h = t.h AND r.size = t.size AND r.doc_id IS NOT DISTINCT FROM t.doc_id
"""


def _filled_sql(sql: str) -> str:
    one = """
e{n} AS (
  SELECT r.doc_id, r.source, r.h, r.size, s.rest, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM run r JOIN s{k} s ON r.source IS NOT DISTINCT FROM s.source
  WHERE NOT s.fits AND s.rest > s.target / 1000 AND r.h > s.after AND r.size <= s.rest AND r.size > 0),
g{n} AS (SELECT source, coalesce(min(h) FILTER (upto > rest), max(h)) AS after, coalesce(max(upto) FILTER (upto <= rest), 0) AS got FROM e{n} GROUP BY source),
s{n} AS (
  SELECT s.source, s.target, s.edge, s.fits, s.over, coalesce(g.after, s.after) AS after, s.rest - coalesce(g.got, 0) AS rest
  FROM s{k} s LEFT JOIN g{n} g ON s.source IS NOT DISTINCT FROM g.source),"""
    steps = "".join(one.format(n=k + 1, k=k) for k in range(FILLS))
    taken = " UNION ALL ".join(f"SELECT doc_id, source, h, size FROM e{k + 1} WHERE upto <= rest" for k in range(FILLS))
    return sql.replace("@FILLS@", steps).replace("@TAKEN@", taken).replace("@LAST@", str(FILLS))


OP3_SQL = _filled_sql(_MIX_SQL)
