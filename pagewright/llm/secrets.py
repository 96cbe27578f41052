"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A blob is scanned once for a
version of the rules; the ledger keeps which pairs were scanned and what was found, and findings join
back to all paths that hold the blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import is_table, materialize
from .sieve import flagged, kept


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # the group whose length counts
    least: int  # its fewest characters


#: The kinds in their listed order, their patterns and least lengths.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of fewer than 24 fail anyway, and none overlaps another
)
RULES_VERSION = "2"


SPANS = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"
CHUNK = 1024  # code points of a chunk in which redacted() looks for a place


def steps(text: Column, rule: Rule) -> Column:
    """array<struct<gap, hit, part>>: lengths of what lies before a match, of the match, and of its part that counts.

    What a pattern splits a text into and what it matches take turns, so running sums give places. Null without match.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        found.alias("hit"),
        (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found).alias("part"),
    )
    return F.when(text.rlike(rule.pattern), F.transform(pairs, lambda x: F.struct(*[F.length(x[c]).alias(c) for c in ("gap", "hit", "part")])))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of those blobs (blob, text; each once) that have any: leftmost non-overlapping matches of each kind, in code points.

    All kinds in order of start, then kind as listed. Lengths of matches move, never texts; the work is
    linear in the matches of a text.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("ord"), steps(F.col("text"), r).alias("steps")) for k, r in enumerate(rules)])
    hits = blobs.select("blob", F.explode(kinds).alias("k")).select("blob", "k.ord", F.posexplode("k.steps")).select("blob", "ord", "pos", "col.*")
    hits = hits.filter("hit IS NOT NULL").repartition("blob")
    run = W.partitionBy("blob", "ord").orderBy("pos")
    stop = F.sum(F.col("gap") + F.col("hit")).over(run)
    spans = hits.select("blob", (stop - F.col("hit")).alias("start"), "ord", stop.alias("stop"), "part")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("ord") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("ord") + 1)
    one = F.struct("start", "ord", "stop", kind.alias("kind"))
    return spans.filter(F.col("part") >= least).groupBy("blob").agg(F.sort_array(F.collect_list(one)).cast(SPANS).alias("spans"))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(
    versions: DataFrame, path: str = "path", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION, store: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Findings by path, and the ledger with what was scanned now.

    versions has a row for each version of a path (path, text); a null text is an empty blob, a null path
    a path of its own. ledger has (blob, rules_version, spans); a pair of blob and version that it holds
    is not scanned again. store is a folder that keeps the ledger between runs: what it holds is read as
    ledger, and what is scanned now is added to it. Repeated rows come back each with the same findings;
    no rows give no findings. The first result has one row (path, blob, spans) per row of versions.

    A blob that one row holds is scanned where it is read. Of others one copy a task moves, so a blob that
    a third of all rows hold costs little.
    """
    spark = versions.sparkSession
    if store and ledger is None and is_table(spark, store):
        ledger = spark.read.parquet(store)
    addressed = versions.select(F.col(path).alias("path"), address(F.col("text")).alias("blob"))
    addressed = materialize(addressed, "secrets_versions")
    holders = addressed.groupBy("blob").agg(F.count("*").alias("n"))
    seen = None if ledger is None else ledger.filter(F.col("rules_version") == version).select("blob")
    unseen = materialize(holders if seen is None else holders.join(seen, "blob", "left_anti"), "secrets_unseen")
    texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    moved = unseen.filter("n > 1").select("blob")
    if seen is not None:
        texts = kept(texts, unseen, F.xxhash64("blob"))
        moved = moved.union(holders.join(seen, "blob", "left_semi").select("blob"))
    texts = flagged(texts, moved, F.xxhash64("blob"), "several")
    dealt = texts.filter("several").groupBy("blob").agg(F.first("text").alias("text"))
    if seen is not None:
        dealt = dealt.join(unseen.select("blob"), "blob", "left_semi")
    spans = scan_blobs(texts.filter("NOT several").select("blob", "text").union(dealt.select("blob", "text")), rules)
    empty = F.array().cast(SPANS)
    scanned = unseen.join(spans.withColumnRenamed("blob", "of"), F.col("blob") == F.col("of"), "left")
    scanned = materialize(scanned.select("blob", F.lit(version).alias("rules_version"), F.coalesce("spans", empty).alias("spans")), "secrets_ledger")
    whole = scanned if ledger is None else ledger.select("blob", "rules_version", "spans").union(scanned)
    if store:
        scanned.write.mode("append").parquet(store)
    now = whole.filter((F.col("rules_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("of"), "spans")
    found = addressed.join(now, addressed.blob == F.col("of"), "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))
    return found, whole


def stretches(found: DataFrame, key: str) -> DataFrame:
    """(key, cuts) of those rows (key, spans; each key once) that have spans: disjoint stretches in order, each with its first span's kind.

    Overlapping spans are one stretch; spans that only touch are two.
    """
    each = found.select(key, F.explode("spans").alias("s")).repartition(key)
    run = W.partitionBy(key).orderBy("s.start", "s.ord")
    before = F.max("s.stop").over(run.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("fresh", F.coalesce(F.col("s.start") >= before, F.lit(True)))
    each = each.withColumn("nth", F.sum(F.col("fresh").cast("long")).over(run))
    cuts = each.groupBy(key, "nth").agg(F.min("s.start").alias("start"), F.max("s.stop").alias("stop"), F.max(F.when(F.col("fresh"), F.col("s.kind"))).alias("kind"))
    return cuts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("cuts"))


def redacted(docs: DataFrame, text: str, cuts: str, out: str) -> DataFrame:
    """docs with a column out: text with each of its cuts (stretches()) replaced by its kind in brackets; without cuts, null.

    Places are looked up in chunks, so the work is linear in the text and in its cuts.
    """
    chunks = F.when(F.size(cuts) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    with_chunks = docs.withColumn("__chunks", chunks)
    c, cut = F.col("__chunks"), F.col(cuts)

    def piece(start: Column, stop: Column | None) -> Column:
        """Code points of the text from start to stop, or to its end."""
        first, at = F.floor(start / CHUNK).cast("int"), (start % CHUNK).cast("int")
        if stop is None:
            rest = F.concat(F.slice(c, first + 1, F.lit(1)), F.slice(c, first + 2, F.greatest(F.size(c) - first - 1, F.lit(0))))
            return F.array_join(rest, "").substr(at + 1, F.lit(2147483647))
        many = F.floor((stop - 1) / CHUNK).cast("int") - first + 1
        return F.when(stop > start, F.array_join(F.slice(c, first + 1, many), "").substr(at + 1, (stop - start).cast("int"))).otherwise("")

    def put(s: Column, k: Column) -> Column:
        before = F.when(k > 0, F.element_at(cut, F.greatest(k, F.lit(1)))["stop"]).otherwise(F.lit(0).cast("bigint"))
        return F.concat(piece(before, s["start"]), F.lit("["), s["kind"], F.lit("]"))

    made = F.concat(F.array_join(F.transform(cut, put), ""), piece(F.element_at(cut, -1)["stop"], None))
    return with_chunks.withColumn(out, F.when(F.size(cuts) > 0, made)).drop("__chunks")


def without_secrets(docs: DataFrame, store: str | None = None) -> DataFrame:
    """(row struct, clean string) per row of docs (doc_id, text, more columns): clean is the redacted text, or null where text holds no secret.

    Only texts that may hold one move to meet their cuts. Repeated rows come back each; a null text has none.
    """
    _, ledger = scan_versions(docs, "doc_id", store=store)
    secret = ledger.filter((F.col("rules_version") == RULES_VERSION) & (F.size("spans") > 0))
    cuts = materialize(stretches(secret, "blob").withColumnRenamed("blob", "of"), "secrets_cuts")
    rows = docs.select(F.struct("*").alias("row"), address(F.col("text")).alias("blob"))
    rows = flagged(rows, cuts.select(F.col("of").alias("blob")), F.xxhash64("blob"), "may")
    held = rows.filter("may").join(cuts, F.col("blob") == F.col("of"), "left").select("row", F.col("row.text").alias("text"), "cuts")
    clean = redacted(held, "text", "cuts", "clean").select("row", "clean")
    return rows.filter("NOT may").select("row", F.lit(None).cast("string").alias("clean")).union(clean)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _ = scan_versions(docs, "doc_id")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = joined(F.col("spans"))
    return found.select(F.col("path").alias("doc_id"), *map(n, ("assign", "access", "hex")), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _sql() -> str:
    def kind(k: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""
  SELECT doc, '{r.kind}' AS kind, {k} AS ord, start, start + length(hit) AS stop FROM (
    SELECT doc, hit, part, sum(length(gap)) OVER (PARTITION BY doc ORDER BY i) + coalesce(sum(length(hit)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(p) AS part, unnest(g[:len(h)]) AS gap
          FROM (SELECT doc, regexp_extract_all(text, '{p}') AS h, regexp_extract_all(text, '{p}', {r.group}) AS p, string_split_regex(text, '{p}') AS g
                FROM d WHERE regexp_matches(text, '{p}'))))
  WHERE length(part) >= {r.least}"""

    kinds = "\n  UNION ALL".join(kind(k, r) for k, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({kinds}),
j AS (SELECT doc, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans,
             count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c FROM s GROUP BY doc)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc)
"""


OP7_SQL = _sql()
