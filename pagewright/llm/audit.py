"""What filters take from each other in every order, by edges of the lattice of their subsets. DataFrame functions only.

A document fails a set of filters. On the edge (filters applied already, next filter) it is kept, removed or
gone before, whatever the order in which the filters of the subset ran. So rows are summed by the set that they
fail, these sums by edge, and every step of every order is an edge on its path from no filter to all.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import materialize
from .sieve import flagged

FILTERS = "ABCDE"  # E is the one that compares a text with others


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A the lowest."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) per row of docs (doc_id, text, source): bits of FILTERS, and whether a label says so.

    Only digests of texts meet each other, and of those only such as may have a copy.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own"))
    narrow = materialize(narrow, "audit_rows")
    # an id that is null comes after all others
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = materialize(firsts.select(F.col("digest").alias("of"), "first"), "audit_firsts")
    rows = flagged(narrow, firsts.select(F.col("of").alias("digest")), F.xxhash64("digest"), "may")
    alone = rows.filter("NOT may").withColumn("again", F.lit(False))
    met = rows.filter("may").join(firsts, F.col("digest") == F.col("of"), "left")
    met = met.withColumn("again", F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))).select(alone.columns)
    whole = alone.union(met).select("doc_id", "part", (F.col("own") + F.when(F.col("again"), 1 << 4).otherwise(0)).alias("fails"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    out = whole.join(marks, F.col("doc_id") == F.col("of"), "left")
    return out.select("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _subsets() -> list[tuple[int, int]]:
    """The lattice's edges: (bits applied, place of the next filter), 80 for five filters."""
    n = len(FILTERS)
    return [(s, k) for s in range(1 << n) for k in range(n) if not s >> k & 1]


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, next): each order's path through the lattice, 600 rows for five filters."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        for at, k in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), at + 1, sum(1 << i for i in order[:at]), k))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def edges(failed: DataFrame) -> DataFrame:
    """Counts per part and edge (applied, next) of rows (part, fails, good, toxic); weight is the number of orders on the edge."""
    per = failed.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    n = len(FILTERS)
    edge = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(k).alias("next"), F.lit(1 << k).alias("bit"), F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())).cast("long").alias("weight")) for s, k in _subsets()])
    e = per.withColumn("edge", F.explode(edge)).select("part", "fails", "good", "toxic", "n", "edge.*")
    gone, hit = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return e.groupBy("part", "applied", "next", "weight").agg(
        count(~gone & ~hit, "kept"), count(~gone & hit, "removed"), count(gone & hit, "redundant"), count(F.col("fails") == F.col("bit"), "unique_fails"),
        count(~gone & hit & F.col("good"), "good_lost"), count(~gone & hit & F.col("toxic"), "toxic_lost"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs is (doc_id, text, source), labels (doc_id, quality, toxic). A null text is empty and fails A only; of
    equal texts, empty ones too, those fail E that aren't of the smallest doc_id, so rows that repeat that id
    pass it together; a null id comes after all others, and rows without any other id pass. A null source
    is the part ''. Of repeated labels one that says 1 is enough; null ids have no label. No rows give no
    rows. Columns beyond those named may be there and have any name.
    """
    per = materialize(edges(failures(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))), "audit_edges")
    share = per.groupBy(F.col("part").alias("of"), F.col("next").alias("filter")).agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    whole = per.join(share, (F.col("part") == F.col("of")) & (F.col("next") == F.col("filter"))).drop("of", "filter", "weight")
    path = F.broadcast(steps(docs.sparkSession))  # 600 rows, whatever the data
    return whole.join(path, ["applied", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) AS c,
         regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > m.first, m.first IS NOT NULL) AS e
  FROM t JOIN m ON t.text = m.text LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (
  SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.c || q.c || r.c || s.c || u.c AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5),
st AS (SELECT filter_order, k::INTEGER AS step, filter_order[k] AS c, filter_order[:k - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
y AS (
  SELECT part, filter_order, step, c, n, good, toxic, fails, contains(fails, c) AS hit,
         len(list_filter(string_split(before, ''), lambda z: contains(fails, z))) > 0 AND before <> '' AS gone
  FROM g, st),
z AS (
  SELECT part, filter_order, step, c,
         sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM z
"""
