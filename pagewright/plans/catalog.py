"""Named queries over the driver's tables, each an application of the library's operators, with DuckDB SQL for it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sql
from ..functions import text as tx
from ..operators import align, assemble, classify, groups, leases, names, ranges, replies, schedule
from ..shared import shared
from ..sources import files, publish, ranged, uploads
from ..streaming import leases as lease_stream, pages as page_stream, play
from . import corpus as co

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# DuckDB's forms of this library's text rules; RE2 has no look-around, so joins of neighbours are applied twice.
_WS = r"[ \t\n\r\f\v]+"
_CJK = "一-鿿㐀-䶿"
_GLUE = _CJK + r"\p{Nd}()\[\]【】「」·"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "　•・"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " ··"
_EDGE = r" ，,。；;：:、\"''“”‘’《》<>【】\[\]"


def _blank(c: str) -> str:
    return rf"({c} IS NULL OR regexp_full_match({c}, '[\s\v\x{{85}}\p{{Z}}]*'))"


def _joined(c: str) -> str:
    t = f"translate({c}, '{_WIDE}', '{_NARROW}')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([{_CJK}]){_WS}([{_GLUE}])', '\\1\\2', 'g')"
        t = f"regexp_replace({t}, '([{_GLUE}]){_WS}([{_CJK}])', '\\1\\2', 'g')"
    return f"regexp_replace({t}, '{_WS}', ' ', 'g')"


def _repair(c: str) -> str:
    """For names without abbreviations at their end."""
    trim = lambda t: f"regexp_replace(regexp_replace({t}, '^[{_EDGE}.]+', ''), '[{_EDGE}.]+$', '')"
    t = trim(_joined(f"coalesce({c}, '')"))
    return f"(CASE WHEN regexp_full_match({t}, '\\(.*\\)') THEN {trim(f'substr({t}, 2, length({t}) - 2)')} ELSE {t} END)"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


_FLAGSHIP_SQL = f"""
WITH {co.SUPPLIER_PAGES}, {co.LINE_PAGES},
p AS (SELECT 'line' AS corpus, doc_id, page, text FROM lp UNION ALL SELECT 'supplier', doc_id, page, text FROM sp),
q AS (SELECT corpus, doc_id, page, regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ɏ]', '0', 'g') AS text FROM p WHERE NOT {_blank("text")}),
n AS (SELECT corpus, doc_id, page, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:[ \\t]+[A-Z][a-z]+)+\\b')) AS name FROM q),
g AS (SELECT corpus, doc_id, page, regexp_replace(name, '[ \\t]+', ' ', 'g') AS name FROM n)
SELECT corpus, name, count(*) AS count, count(DISTINCT doc_id) AS docs, min(page) AS first_page FROM g
WHERE length(name) BETWEEN 3 AND 40 AND NOT regexp_matches(name, '(?i)(?:Inc\\.?|Ltd\\.?|LLC|Corp\\.?|Co\\.|Company|Corporation)\\b|university|company')
GROUP BY corpus, name
"""


@query(_FLAGSHIP_SQL)
def person_rollup(spark, sf_dir):
    tag = lambda df, c: df.select(F.lit(c).alias("corpus"), "doc_id", "page", "text")
    pages = tag(co.line_pages(spark, sf_dir), "line").union(tag(co.supplier_pages(spark, sf_dir), "supplier"))
    found = pages.filter(names.may_name_a_person(F.col("text"))).select("corpus", "doc_id", "page", F.explode(names.english_persons(F.col("text"))).alias("name"))
    return found.groupBy("corpus", "name").agg(F.count("*").alias("count"), F.count_distinct("doc_id").alias("docs"), F.min("page").alias("first_page"))


_FORMS = r"(?:Inc\.?|Ltd\.?|LLC|Corp\.?|Co\.|Company|Corporation)"
_TIGHT = r"regexp_replace(trim({}, ' ' || chr(9) || chr(10) || chr(13) || '　'), '[ \t　]+', ' ', 'g')"
_NAME_EDGE = r" \t　、，,。;；:：\"''“”（）()"


def _cleaned(c: str) -> str:
    """A company's name without its edges."""
    t = f"regexp_replace(regexp_replace({_TIGHT.format(c)}, '^[{_NAME_EDGE}.]+', ''), '[{_NAME_EDGE}]+$', '')"
    return _TIGHT.format(f"regexp_replace({t}, '^[的与和及/|-]+', '')")


@query(f"""
WITH {co.SUPPLIER_PAGES},
t AS (SELECT doc_id, page, text FROM sp WHERE NOT {_blank("text")}),
r AS (SELECT doc_id, page, false AS needs_form, unnest(regexp_extract_all(text, '(?:公司名称|企业名称|单位名称|甲方|乙方|丙方|委托方|受托方|出卖人|买受人)[：:\\s]+([^\\n\\r，。；;]{{2,40}})', 1)) AS raw FROM t
  UNION ALL SELECT doc_id, page, true, unnest(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9&.\\-]*(?:[ \\t]+[A-Z][A-Za-z0-9&.\\-]*)*(?:[ \\t]*,?[ \\t]*)?{_FORMS}\\b')) FROM t),
s AS (SELECT doc_id, page, needs_form, {_cleaned("raw")} AS name FROM r)
SELECT doc_id, page, CASE WHEN regexp_matches(name, '(?i)(?:Ltd|Inc|Corp)$') THEN name || '.' ELSE name END AS name FROM s
WHERE length(name) BETWEEN 2 AND 60 AND (regexp_matches(name, '(?:{"|".join(names.SUFFIXES)})$') OR regexp_matches(name, '(?i){_FORMS}\\b')
  OR (NOT needs_form AND length(regexp_replace(name, '[^{_CJK}]', '', 'g')) >= 2 AND length(name) >= 4))
""")
def label_company_extract(spark, sf_dir):
    return names.label_names(co.supplier_pages(spark, sf_dir)).filter("kind = 'company'").select("doc_id", "page", "name")


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_NO_PERSON = "|".join((*names.NO_PERSON, *names.SUFFIXES))


def _person(c: str) -> str:
    """Whether c, folded, can be a person's name."""
    return rf"""(length({c}) BETWEEN 2 AND 4 AND regexp_full_match({c}, '[{_CJK}·]+') AND NOT regexp_matches({c}, '{_NO_PERSON}') AND NOT regexp_matches({c}, '(?:{"|".join(names.TITLES)})$')
      AND ((length({c}) >= 3 AND substr({c}, 1, 2) IN ({_in(names.COMPOUND_SURNAMES)})) OR substr({c}, 1, 1) IN ({_in(names.SURNAMES)})))"""


_HEURISTICS = rf"""t AS (SELECT doc_id, page, text FROM np WHERE NOT {_blank("text")}),
sx AS (SELECT doc_id, page, text, x, string_split(text, x) AS s FROM t, (VALUES {", ".join(f"('{x}')" for x in names.SUFFIXES)}) v(x) WHERE contains(text, x)),
sa AS (SELECT *, list_sum(list_transform(s[:i], lambda y: length(y))) + (i - 1) * length(x) AS pos FROM sx, LATERAL (SELECT unnest(range(1, len(s))) AS i)),
sr AS (SELECT *, regexp_extract(substr(text, (greatest(pos - 40, 0) + 1)::BIGINT, least(pos, 40)::BIGINT), '[{_CJK}A-Za-z0-9·•&-]*$') AS run FROM sa),
sc AS (SELECT doc_id, page, CASE WHEN pos > length(run) AND length(run) < 40 THEN run ELSE regexp_replace(run, '^(?:{"|".join(names.CONNECTORS)})*(.)', '\1') END || x AS raw FROM sr),
cn AS (SELECT doc_id, page, {_cleaned("raw")} AS name FROM sc WHERE length(raw) >= 4),
company AS (SELECT doc_id, page, 'company' AS kind, name FROM cn WHERE length(name) BETWEEN 2 AND 60 AND regexp_matches(name, '(?:{"|".join(names.SUFFIXES)})$')),
pr AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '(?:{"|".join(names.PERSON_LABELS)})[：:\s\p{{Z}}]+([一-鿿·•]{{2,4}})', 1) || regexp_extract_all(text, '([一-鿿]{{2,4}})(?:{"|".join(names.NAME_TITLES)})', 1)) AS raw FROM t),
ruled AS (SELECT doc_id, page, 'person' AS kind, replace(raw, '•', '·') AS name FROM pr WHERE {_person("replace(raw, '•', '·')")}),
ps AS (SELECT doc_id, page, text, unnest(range(1, length(text) + 1)) AS i FROM t),
pc AS (SELECT doc_id, page, i, pri, replace(substr(text, i, w + g), '•', '·') AS name, substr(text, i + w, 24) AS given, substr(text, i + w + g, 24) AS rest, g
  FROM ps, (VALUES (1, 2, 2), (2, 2, 1), (3, 1, 2), (4, 1, 1)) v(pri, w, g)
  WHERE regexp_matches(substr(text, i, 1), '[{_CJK}]') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[{_CJK}]')) AND i + w + g - 1 <= length(text)
    AND CASE WHEN w = 2 THEN substr(text, i, 2) IN ({_in(names.COMPOUND_SURNAMES)}) ELSE substr(text, i, 1) IN ({_in(names.SURNAMES)}) END),
pg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, i ORDER BY pri) AS nth FROM pc
  WHERE {_person("name")} AND regexp_full_match(substr(given, 1, g), '[{_CJK}·•]+') AND NOT regexp_matches(given, CASE WHEN g = 2 THEN '^.?(?:{"|".join(names.SUFFIXES)})' ELSE '^(?:{"|".join(names.SUFFIXES)})' END)
    AND (NOT regexp_matches(rest, '^[{_CJK}·•]') OR regexp_matches(rest, '^(?:{"|".join(names.TITLES)})')) AND NOT regexp_matches(substr(rest, 1, 20), '(?s)^.{{0,12}}(?:{"|".join(names.SUFFIXES)})')),
hn AS (SELECT * FROM company UNION ALL SELECT * FROM ruled UNION ALL SELECT doc_id, page, 'person', name FROM pg WHERE nth = 1)"""


@query(f"""WITH {co.NAME_PAGES}, {_HEURISTICS}, c AS (SELECT doc_id, kind, name, count(*) AS count, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM hn GROUP BY doc_id, kind, name)
SELECT *, (row_number() OVER (PARTITION BY doc_id, kind ORDER BY count DESC, name))::INTEGER AS place FROM c""")
def heuristic_names(spark, sf_dir):
    return assemble.ranked(assemble.roll_up(names.heuristic_names(co.name_pages(spark, sf_dir)))).withColumn("pages", F.array_join("pages", ","))


# Page selection

def _entry(k: str) -> str:
    """An entry of a page selection by a whole number; in both dialects."""
    n, m = f"CAST({k} % 97 + 1 AS STRING)", f"CAST({k} % 97 + 1 + {k} % 5 AS STRING)"
    return f"""CASE {k} % 41 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '+' || {n} WHEN 3 THEN {n} || '-1-2' WHEN 4 THEN '1000001' WHEN 5 THEN {m} || ' - ' || '1' WHEN 6 THEN 'p' || {n} WHEN 7 THEN '-' || {n}
    WHEN 8 THEN '0-' || {n} WHEN 9 THEN {n} || '-1000001' ELSE CASE {k} % 3 WHEN 0 THEN {n} WHEN 1 THEN ' ' || {n} || ' -  ' || {m} || ' ' ELSE {n} || '-' || {m} END END"""


#: Up to four entries, of which one in four is wrong in some way; some selections are blank or null.
_SPEC = f"""CASE WHEN c_custkey % 89 = 0 THEN NULL WHEN c_custkey % 83 = 0 THEN '  ' ELSE concat_ws(',', {_entry("(c_custkey * 7 + 11)")},
  CASE WHEN c_custkey % 4 > 0 THEN {_entry("(c_custkey * 13 + 12)")} END, CASE WHEN c_custkey % 4 > 1 THEN {_entry("(c_custkey * 29 + 13)")} END, CASE WHEN c_custkey % 4 > 2 THEN {_entry("(c_custkey * 31 + 14)")} END) END"""


@query(rf"""
WITH s AS (SELECT c_custkey, {_SPEC} AS spec FROM customer),
e AS (SELECT c_custkey, unnest(string_split(spec, ',')) AS raw, generate_subscripts(string_split(spec, ','), 1) AS i FROM s WHERE spec IS NOT NULL),
x AS (SELECT c_custkey, i, trim(raw) AS x, TRY_CAST(regexp_extract(trim(raw), '^(\d{{1,18}})(?:\s*-\s*\d{{1,18}})?$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(trim(raw), '^\d{{1,18}}\s*-\s*(\d{{1,18}})$', 1) AS BIGINT) AS b FROM e),
w AS (SELECT c_custkey, i, a, coalesce(b, a) AS z, CASE WHEN x = '' THEN 'empty entry' WHEN a IS NULL THEN 'not a page or a range' WHEN a < 1 THEN 'page below 1' WHEN a > 1000000 OR coalesce(b, a) > 1000000 THEN 'page too large' WHEN b < a THEN 'range runs backwards' END AS wrong FROM x),
g AS (SELECT c_custkey, arg_min(wrong, i) FILTER (wrong IS NOT NULL) AS wrong, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ',' ORDER BY a, z) AS ranges FROM w GROUP BY c_custkey)
SELECT s.c_custkey, spec, CASE WHEN trim(spec) = '' THEN 'empty selection' ELSE wrong END AS error, CASE WHEN wrong IS NULL AND trim(spec) <> '' THEN ranges END AS canonical FROM s LEFT JOIN g ON g.c_custkey = s.c_custkey
""")
def page_spec_parse(spark, sf_dir):
    c = co.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SPEC).alias("spec")).withColumn("parsed", ranges.parse_spec(F.col("spec")))
    return c.select("c_custkey", "spec", F.col("parsed.error").alias("error"), ranges.format_ranges(F.col("parsed.ranges")).alias("canonical"))


_MERGED = f"""{co.LINE_RANGES},
m1 AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM lr),
m2 AS (SELECT *, sum(CASE WHEN start <= reached + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS island FROM m1),
mr AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM m2 GROUP BY doc_id, island)"""


@query(f"WITH {_MERGED} SELECT doc_id, start, stop FROM mr")
def range_merge(spark, sf_dir):
    return ranges.merge_ranges(co.line_ranges(spark, sf_dir))


def _documents(spark, sf_dir):
    return co.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("o_custkey % 50 + 1").alias("n_pages"))


_DOCS = "dd AS (SELECT o_orderkey AS doc_id, o_custkey % 50 + 1 AS n_pages FROM orders)"


@query(f"""WITH {_MERGED}, {_DOCS},
c AS (SELECT doc_id, n_pages, start, CASE WHEN start <= n_pages THEN least(stop, n_pages) END AS cut, stop FROM mr JOIN dd USING (doc_id))
SELECT doc_id, n_pages, coalesce(string_agg(CASE WHEN start = cut THEN start::VARCHAR ELSE start || '-' || cut END, ',' ORDER BY start) FILTER (cut IS NOT NULL), '') AS processed,
  coalesce(sum(cut - start + 1), 0)::BIGINT AS selected, max(stop) > n_pages AS clamped, CASE WHEN count(cut) = 0 THEN 'no page of the document is selected' END AS error
FROM c GROUP BY doc_id, n_pages""")
def range_resolve(spark, sf_dir):
    return ranges.resolve(ranges.merge_ranges(co.line_ranges(spark, sf_dir)), _documents(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 30 AS page FROM lineitem),
r AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM p)
SELECT doc_id, min(page) AS start, max(page) AS stop FROM r GROUP BY doc_id, run""")
def range_islands(spark, sf_dir):
    return ranges.islands(co.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("l_partkey % 30").alias("page")))


@query("SELECT l_orderkey AS doc_id, (max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*)) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_pages(spark, sf_dir):
    return ranges.contiguous(co.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")))


_TURN_RANGES = "rg AS (SELECT conv_id AS doc_id, conv_id % 3 + 1 AS start, conv_id % 3 + 2 AS stop FROM conversations)"


def _turn_ranges(spark, sf_dir):
    return co.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.expr("conv_id % 3 + 1").alias("start"), F.expr("conv_id % 3 + 2").alias("stop"))


@query(f"WITH {co.TURN_PAGES}, {_TURN_RANGES} SELECT doc_id, page, text FROM tp WHERE EXISTS (SELECT 1 FROM rg WHERE rg.doc_id = tp.doc_id AND page BETWEEN start AND stop)")
def page_semi_filter(spark, sf_dir):
    return ranges.select_pages(co.turn_pages(spark, sf_dir), _turn_ranges(spark, sf_dir))


@query(f"""WITH {co.TURN_PAGES}, n AS (SELECT doc_id, max(page) + 2 AS n_pages FROM tp GROUP BY doc_id), k AS (SELECT * FROM tp WHERE page % 2 = 1)
SELECT n.doc_id, g.page::INTEGER AS page, coalesce(k.text, '') AS text FROM n, LATERAL (SELECT unnest(range(1, n_pages + 1)) AS page) g LEFT JOIN k ON k.doc_id = n.doc_id AND k.page = g.page""")
def skipped_as_blank(spark, sf_dir):
    """Every second page was selected; the operator puts blanks for the others."""
    pages = co.turn_pages(spark, sf_dir)
    totals = pages.groupBy("doc_id").agg((F.max("page") + 2).alias("n_pages"))
    return ranges.blanks_for_skipped(pages.filter("page % 2 = 1"), totals)


@query("""SELECT p_partkey, CASE WHEN a IS NULL THEN CASE WHEN b > 0 THEN greatest(n - b, 0) END WHEN a < n AND (b IS NULL OR b >= a) THEN a END AS start,
  CASE WHEN a IS NULL THEN CASE WHEN b > 0 THEN n - 1 END WHEN a < n AND (b IS NULL OR b >= a) THEN least(coalesce(b, n - 1), n - 1) END AS stop
FROM (SELECT p_partkey, (p_size * 10)::BIGINT AS n, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 400 END AS a, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 300 END AS b FROM part)""")
def byte_range_slice(spark, sf_dir):
    p = co.table(spark, sf_dir, "part").select("p_partkey", F.expr("cast(p_size * 10 AS bigint)").alias("n"), F.expr("CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 400 END").alias("a"), F.expr("CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 300 END").alias("b"))
    s = ranges.byte_slice(F.col("n"), F.col("a"), F.col("b"))
    return p.withColumn("s", s).select("p_partkey", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


# Pages: filters, classification, projections

@query(f"WITH {co.LINE_PAGES} SELECT doc_id, count(*) AS pages, count(*) FILTER ({_blank('text')}) AS blank_pages FROM lp GROUP BY doc_id")
def page_blank_filter(spark, sf_dir):
    return co.line_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(tx.blank(F.col("text"))).alias("blank_pages"))


_STATS = """st AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' OFF' WHEN 1 THEN 'Force' WHEN 2 THEN 'other' END AS mode, text, length(text)::BIGINT AS char_count,
  CASE WHEN doc_id % 5 = 0 THEN length(text) // 20 ELSE 0 END::BIGINT AS unknown_count, (doc_id % 11)::BIGINT AS text_objects, doc_id % 13 = 0 AS invisible, (doc_id % 10) / 10 AS image_coverage FROM documents)"""


def _stats(spark, sf_dir):
    return co.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("CASE doc_id % 9 WHEN 0 THEN ' OFF' WHEN 1 THEN 'Force' WHEN 2 THEN 'other' END").alias("mode"), "text", F.expr("cast(length(text) AS bigint)").alias("char_count"),
        F.expr("cast(CASE WHEN doc_id % 5 = 0 THEN length(text) div 20 ELSE 0 END AS bigint)").alias("unknown_count"), F.expr("doc_id % 11").alias("text_objects"), F.expr("doc_id % 13 = 0").alias("invisible"), F.expr("(doc_id % 10) / 10").alias("image_coverage"),
    )


@query(f"""WITH {_STATS}, s AS (SELECT *, length(regexp_replace(coalesce(text, ''), '[\\s\\v\\x{{85}}\\p{{Z}}]', '', 'g')) AS seen, lower(trim(coalesce(mode, ''))) AS m, image_coverage >= 0.55 OR invisible AS on_image FROM st),
r AS (SELECT doc_id, CASE WHEN m = 'off' THEN 'off' WHEN text_objects = 0 OR seen = 0 THEN 'no-text' WHEN m = 'force' THEN 'force' WHEN unknown_count / greatest(char_count, seen) > 0.02 THEN 'unknown-chars'
  WHEN on_image AND seen < 200 THEN 'image-little-text' WHEN NOT on_image AND seen < 40 THEN 'short-text' WHEN invisible THEN 'invisible-layer' ELSE 'text' END AS reason FROM s)
SELECT doc_id, reason, reason IN ('force', 'text', 'invisible-layer') AS use_layer FROM r""")
def text_layer_classify(spark, sf_dir):
    return classify.classify_layer(_stats(spark, sf_dir)).select("doc_id", "reason", "use_layer")


@query(f"WITH {co.TURN_PAGES} SELECT doc_id, count(*) FILTER (page % 3 = 0) AS layer_pages, count(*) FILTER (page % 3 <> 0) AS ocr_pages FROM tp GROUP BY doc_id")
def page_source_counts(spark, sf_dir):
    p = co.turn_pages(spark, sf_dir).withColumn("source", F.when(F.col("page") % 3 == 0, "textLayer").otherwise("ocr"))
    return classify.source_counts(p)


@query(f"WITH {co.TURN_PAGES} SELECT doc_id, page FROM tp WHERE NOT {_blank('text')} OR page % 4 = 0")
def visible_pages(spark, sf_dir):
    return classify.visible(co.turn_pages(spark, sf_dir).withColumn("rule_count", F.when(F.col("page") % 4 == 0, 1).otherwise(0))).select("doc_id", "page")


@query(f"""WITH {co.SUPPLIER_PAGES} SELECT doc_id, page, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?|\\f', chr(10), 'g'), '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', ''), 'x', 'x') AS text FROM sp""")
def linebreak_normalize(spark, sf_dir):
    return co.supplier_pages(spark, sf_dir).withColumn("text", tx.line_breaks(F.col("text")))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\v\x{85}\p{Z}]', '', 'g'))::BIGINT AS seen FROM documents")
def nonspace_count(spark, sf_dir):
    return co.table(spark, sf_dir, "documents").select("doc_id", tx.nonspace_count(F.col("text")).alias("seen"))


@query(f"""WITH {co.TURN_PAGES}, a AS (SELECT doc_id, unnest(range(1, 8))::INTEGER AS page FROM (SELECT DISTINCT doc_id FROM tp)), r AS (SELECT *, (page * doc_id % 40)::DOUBLE AS ocr_ms FROM tp),
m AS (SELECT doc_id, round_even(sum(ocr_ms) / count(*), 1) AS ms_per_page FROM r GROUP BY doc_id)
SELECT a.doc_id, a.page, coalesce(text, '') AS text, coalesce(ocr_ms, 0.0)::DOUBLE AS ocr_ms, ms_per_page FROM a LEFT JOIN r USING (doc_id, page) LEFT JOIN m USING (doc_id)""")
def debug_projection(spark, sf_dir):
    p = co.turn_pages(spark, sf_dir)
    asked = p.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return classify.debug_pages(asked, p.withColumn("ocr_ms", F.expr("cast(page * doc_id % 40 AS double)")))


# Groups

@query(f"""WITH {co.TURN_PAGES} SELECT doc_id, page, (SELECT substr(n.text, 1, 240) FROM tp n WHERE n.doc_id = tp.doc_id AND n.page > tp.page AND NOT {_blank('n.text')} ORDER BY n.page LIMIT 1) AS head FROM tp""")
def lookahead_head(spark, sf_dir):
    return groups.lookahead(co.turn_pages(spark, sf_dir)).select("doc_id", "page", "head")


@query(f"""WITH {co.TURN_PAGES}, k AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 3 AS g FROM tp WHERE NOT {_blank('text')})
SELECT doc_id, g::INTEGER AS group_no, string_agg(page, ',' ORDER BY page) AS pages FROM k GROUP BY ALL""")
def group_fixed_n(spark, sf_dir):
    return groups.fixed_groups(co.turn_pages(spark, sf_dir), 3).withColumn("pages", F.array_join("pages", ","))


@query(f"""WITH RECURSIVE {co.TURN_PAGES},
b AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i, least(length('--- page ' || page || ' ---' || chr(10) || text || chr(10)), 2001) AS n FROM tp WHERE NOT {_blank('text')}),
w(doc_id, i, page, g, cnt, size) AS (
  SELECT doc_id, i, page, 0, CASE WHEN n > 2000 THEN 99 ELSE 1 END, n FROM b WHERE i = 1
  UNION ALL
  SELECT b.doc_id, b.i, b.page, CASE WHEN new THEN w.g + 1 ELSE w.g END, CASE WHEN b.n > 2000 THEN 99 WHEN new THEN 1 ELSE w.cnt + 1 END, CASE WHEN new THEN b.n ELSE w.size + b.n END
  FROM (SELECT w.*, b.n AS bn, (w.cnt >= 4 OR w.size + b.n > 2000) AS new FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1) w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
SELECT doc_id, g::INTEGER AS group_no, string_agg(page, ',' ORDER BY page) AS pages FROM w GROUP BY doc_id, g""")
def group_char_cap(spark, sf_dir):
    return groups.char_groups(co.turn_pages(spark, sf_dir), 4, 2000).select("doc_id", "group_no", F.array_join("pages", ",").alias("pages"))


@query(f"WITH {co.TURN_PAGES} SELECT doc_id, page, '--- page ' || page || ' ---' || chr(10) || text || chr(10) || CASE WHEN h IS NULL THEN '' ELSE '--- next ---' || chr(10) || h || chr(10) END AS prompt FROM (SELECT *, substr(lead(text) OVER (PARTITION BY doc_id ORDER BY page), 1, 9) AS h FROM tp)")
def prompt_format(spark, sf_dir):
    from pyspark.sql import Window

    p = co.turn_pages(spark, sf_dir).withColumn("h", F.substring(F.lead("text").over(Window.partitionBy("doc_id").orderBy("page")), 1, 9))
    return p.select("doc_id", "page", tx.with_lookahead(tx.page_block(F.col("page"), F.col("text")), F.col("h")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 3000) || chr(10) || '...' || chr(10) || right(text, 3000) ELSE text END AS text FROM documents")
def repair_prompt_clip(spark, sf_dir):
    return co.table(spark, sf_dir, "documents").select("doc_id", tx.clip_middle(F.col("text"), 6000).alias("text"))


@query("SELECT conv_id, turn, replace(replace(replace(text, 'tion', '***'), 'the', '***'), 'on', '***') AS text FROM conversations")
def secret_redaction(spark, sf_dir):
    return co.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.redact(F.col("text"), ["on", "tion", "the", ""]).alias("text"))


# Names

@query(f"WITH {co.SUPPLIER_PAGES} SELECT doc_id, page, {_joined('text')} AS text FROM sp")
def repair_cjk(spark, sf_dir):
    return co.supplier_pages(spark, sf_dir).withColumn("text", tx.joined_space(F.col("text")))


#: In both dialects: names as they are read, with edges, titles and brackets around them, by c_custkey.
_AS_READ = """CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '（' WHEN 3 THEN '“' ELSE '审判长' END ||
  CASE (c_custkey // 5) % 16 WHEN 0 THEN '张 伟' WHEN 1 THEN '王某' WHEN 2 THEN '李娜' WHEN 3 THEN '原告' WHEN 4 THEN '星 河3有限公司' WHEN 5 THEN '海光集团' WHEN 6 THEN '本公司' WHEN 7 THEN '中州大学' WHEN 8 THEN '某市人民法院'
  WHEN 9 THEN '人民法院服务公司' WHEN 10 THEN '司马相如' WHEN 11 THEN '阿凡·提江' WHEN 12 THEN 'Mary  Ann' WHEN 13 THEN '一二三四五六七' WHEN 14 THEN '有限公司' ELSE '平安银行' END ||
  CASE (c_custkey // 80) % 6 WHEN 0 THEN '' WHEN 1 THEN '，' WHEN 2 THEN '先生' WHEN 3 THEN '。 ' WHEN 4 THEN '）' ELSE '总经理' END"""
_RAW = f"rw AS (SELECT c_custkey // 7 AS doc_id, c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'company' END AS kind, {_AS_READ} AS name FROM customer)"


def _raw(spark, sf_dir):
    c = co.table(spark, sf_dir, "customer")
    kind = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'person' ELSE 'company' END")
    return c.select(F.expr("c_custkey div 7").alias("doc_id"), F.col("c_custkey").alias("ord"), kind.alias("kind"), F.expr(_AS_READ.replace("//", "div")).alias("name"))


_NO_FORM = "NOT contains(name, '公司')"
_COMPANY = f"""(length(name) BETWEEN 4 AND 80 AND name NOT IN ({_in(tx.GENERIC_COMPANIES)}) AND NOT ({_NO_FORM} AND regexp_matches(name, '{tx.any_of(tx.GOVERNMENT)}'))
  AND NOT ({_NO_FORM} AND regexp_matches(name, '(?:{tx.any_of(tx.INSTITUTIONS)})$')) AND regexp_matches(name, '(?:{tx.any_of(tx.ORG_SUFFIXES)})$'))"""
_CAN_BE_PERSON = rf"""(length(name) BETWEEN 2 AND 40 AND NOT contains(name, '某') AND name NOT IN ({_in(tx.ROLE_WORDS)}) AND NOT {_COMPANY}
  AND (length(regexp_replace(name, '[^\p{{L}}]|[{_CJK}]', '', 'g')) > 0 OR length(regexp_replace(name, '[^{_CJK}]', '', 'g')) BETWEEN 2 AND CASE WHEN contains(name, '·') THEN 16 ELSE 6 END))"""
_UNTITLED = rf"trim(regexp_replace(trim(regexp_replace(name, '^(.{{2,}}?)(?:{tx.any_of(tx.PERSON_TITLES)})$', '\1')), '^(?:{tx.any_of(tuple(sorted(tx.PERSON_TITLES, key=len, reverse=True)))})(.{{2,}})$', '\1'))"
_GOOD = f"""{_RAW}, rr AS (SELECT doc_id, ord, kind, {_repair('name')} AS name FROM rw), ru AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'person' THEN {_UNTITLED} ELSE name END AS name FROM rr),
gd AS (SELECT * FROM ru WHERE name <> '' AND CASE WHEN kind = 'person' THEN {_CAN_BE_PERSON} ELSE {_COMPANY} END),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, name ORDER BY ord) AS n FROM gd) WHERE n = 1)"""


@query(f"WITH {_GOOD} SELECT doc_id, ord, kind, name FROM fr")
def name_filter(spark, sf_dir):
    return align.acceptable_names(_raw(spark, sf_dir)).select("doc_id", "ord", "kind", "name")


@query(f"WITH {_RAW}, t AS (SELECT *, {_repair('name')} AS fixed FROM rw) SELECT doc_id, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fixed ORDER BY ord) AS n FROM t) WHERE n = 1")
def ordered_distinct(spark, sf_dir):
    return assemble.first_of_identity(_raw(spark, sf_dir)).select("doc_id", "ord", "name")


#: In both dialects: a name, and the same one with none, one or two characters changed, by c_custkey.
_SAID = """CASE c_custkey % 7 WHEN 0 THEN '星河科技有限公司' WHEN 1 THEN '海光技术股份有限公司' WHEN 2 THEN '未来银行' WHEN 3 THEN '大庆土木工程集团' WHEN 4 THEN '公司' WHEN 5 THEN '中国人寿保险公司' ELSE '徽州行政大厦' END"""
_READ = f"""CASE (c_custkey // 7) % 9 WHEN 0 THEN {_SAID} WHEN 1 THEN replace({_SAID}, '司', '同') WHEN 2 THEN replace({_SAID}, '术', '木') WHEN 3 THEN replace({_SAID}, '份', '分') WHEN 4 THEN replace(replace({_SAID}, '技', '枝'), '有', '右')
  WHEN 5 THEN replace({_SAID}, '大', '太') WHEN 6 THEN replace({_SAID}, '人', '入') WHEN 7 THEN replace({_SAID}, '公', '么') ELSE {_SAID} || '司' END"""
_PAIRS = ", ".join(f"'{p}', '{p[::-1]}'" for p in tx.LOOKALIKES)


@query(f"""WITH p AS (SELECT c_custkey, {_READ} AS a, {_SAID} AS b FROM customer),
d AS (SELECT *, list_filter(list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1) || substr(b, i, 1)), lambda x: substr(x, 1, 1) <> substr(x, 2, 1)) AS apart FROM p)
SELECT c_custkey, a, b, length(a) = length(b) AND length(a) >= 6 AND len(apart) = 1 AND apart[1] IN ({_PAIRS}) AS alike FROM d""")
def confusion_pair(spark, sf_dir):
    c = co.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_READ.replace("//", "div")).alias("a"), F.expr(_SAID).alias("b"))
    return c.withColumn("alike", F.coalesce(tx.confusable(F.col("a"), F.col("b")), F.lit(False)))


_WANTED = "wn AS (SELECT s_suppkey // 5 AS doc_id, '星河' || s_suppkey % 17 || x AS name FROM supplier, (VALUES ('有限公司'), ('有限公司分公司'), ('股份有限公司')) v(x))"


def _wanted(spark, sf_dir):
    tail = F.explode(F.array(*map(F.lit, ("有限公司", "有限公司分公司", "股份有限公司"))))
    s = co.table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 5").alias("doc_id"), F.expr("s_suppkey % 17").alias("k"), tail.alias("x"))
    return s.select("doc_id", F.concat(F.lit("星河"), F.col("k"), F.col("x")).alias("name"))


_CONTAINED = f"""{co.SUPPLIER_PAGES}, {_WANTED}, nm AS (SELECT doc_id, page, {_joined('text')} AS norm FROM sp WHERE NOT {_blank('text')}),
cn AS (SELECT nm.doc_id, page, name, norm FROM nm JOIN (SELECT DISTINCT * FROM wn) w ON w.doc_id = nm.doc_id AND contains(norm, name))"""


@query(f"WITH {_CONTAINED} SELECT doc_id, page, name, ((length(norm) - length(replace(norm, name, ''))) // length(name))::BIGINT AS count FROM cn")
def containment_count(spark, sf_dir):
    return align.containment(co.supplier_pages(spark, sf_dir), _wanted(spark, sf_dir))


@query(f"""WITH {_CONTAINED}, sx AS (SELECT doc_id, page, name, string_split(norm, name) AS s FROM cn),
hx AS (SELECT doc_id, page, name, i, s FROM sx, LATERAL (SELECT unnest(range(1, len(s))) AS i)),
ht AS (SELECT doc_id, page, name, (list_sum(list_transform(s[:i], lambda x: length(x))) + (i - 1) * length(name))::INTEGER AS start FROM hx),
h AS (SELECT *, (start + length(name))::INTEGER AS stop FROM ht)
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.page = h.page AND o.start <= h.start AND o.stop >= h.stop AND o.stop - o.start > h.stop - h.start AND contains(o.name, h.name))""")
def coverage_anti_join(spark, sf_dir):
    return align.uncovered_hits(align.find_positions(co.supplier_pages(spark, sf_dir), _wanted(spark, sf_dir)))


@query(f"WITH {_WANTED}, u AS (SELECT DISTINCT * FROM wn) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.doc_id = u.doc_id AND length(o.name) > length(u.name) AND contains(o.name, u.name))")
def contained_suppress(spark, sf_dir):
    return align.suppress_contained(_wanted(spark, sf_dir).distinct())


@query(f"""WITH {_WANTED}, u AS (SELECT DISTINCT * FROM wn UNION SELECT doc_id, replace(name, '星河', '') FROM wn)
SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.doc_id = u.doc_id AND length(o.name) > length(u.name) AND contains(o.name, u.name) AND NOT (starts_with(o.name, u.name) AND contains(substr(o.name, length(u.name) + 1), '分公司')))""")
def longer_name_suppress(spark, sf_dir):
    w = _wanted(spark, sf_dir)
    return align.suppress_short(w.union(w.select("doc_id", F.replace("name", F.lit("星河"), F.lit("")))))


@query(f"""WITH {co.SUPPLIER_PAGES}, n AS (SELECT DISTINCT s_suppkey // 5 AS doc_id, '星河' || s_suppkey % 17 AS name FROM supplier), t AS (SELECT doc_id, {_joined('text')} AS norm FROM sp),
m AS (SELECT n.doc_id, n.name, unnest(regexp_extract_all(norm, '(?:^|[^{_CJK}·\\p{{Nd}}])(' || name || '(?:股份有限公司|有限责任公司|有限公司|股份公司))', 1)) AS hit FROM n JOIN t ON t.doc_id = n.doc_id)
SELECT n.doc_id, n.name, coalesce(max_by(hit, (length(hit), hit)), n.name) AS "full" FROM n LEFT JOIN m ON m.doc_id = n.doc_id AND m.name = n.name GROUP BY n.doc_id, n.name""")
def legal_form_expand(spark, sf_dir):
    n = co.table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 5").alias("doc_id"), F.expr("'星河' || s_suppkey % 17").alias("name")).distinct()
    return align.expand_legal_form(co.supplier_pages(spark, sf_dir), n)


_BRANCH = f"(starts_with(o.name, u.name) AND regexp_matches(substr(o.name, length(u.name) + 1), '{tx.any_of(tx.BRANCHES)}'))"


def _found(names_: str, out: str) -> str:
    """Hits of names_ (doc_id, kind, name) that begin on their page and that no hit of a longer name encloses; companies cover companies, both cover persons."""
    return f"""{out}_m AS (SELECT DISTINCT pn.doc_id, pn.page, pn.own, n.kind, n.name, string_split(pn.norm, n.name) AS s FROM pn JOIN {names_} n ON n.doc_id = pn.doc_id AND contains(pn.norm, n.name)),
{out}_p AS (SELECT doc_id, page, own, kind, name, i, list_sum(list_transform(s[:i], lambda x: length(x))) + (i - 1) * length(name) AS start FROM {out}_m, LATERAL (SELECT unnest(range(1, len(s))) AS i)),
{out}_h AS (SELECT *, start + length(name) AS stop FROM {out}_p WHERE start < own),
{out} AS (SELECT * FROM {out}_h h WHERE NOT EXISTS (SELECT 1 FROM {out}_h o WHERE o.doc_id = h.doc_id AND o.page = h.page AND (o.kind = 'company' OR h.kind = 'person') AND o.start <= h.start AND o.stop >= h.stop
  AND length(o.name) > length(h.name) AND contains(o.name, h.name)))"""


_ENTITIES = f"""{_HEURISTICS}, ra AS (SELECT DISTINCT doc_id, kind, {_repair("name")} AS name FROM hn),
ok AS (SELECT * FROM ra WHERE CASE WHEN kind = 'company' THEN {_COMPANY} ELSE {_CAN_BE_PERSON} END),
nx AS (SELECT doc_id, page, text, (SELECT substr(n.text, 1, 240) FROM t n WHERE n.doc_id = t.doc_id AND n.page > t.page ORDER BY n.page LIMIT 1) AS head FROM t),
pn AS (SELECT doc_id, page, {_joined("text")} AS plain, {_joined("text || coalesce(chr(10) || head, '')")} AS norm, length(regexp_replace({_joined("text")}, ' +$', '')) AS own FROM nx),
lf AS (SELECT ok.doc_id, ok.name, unnest(regexp_extract_all(pn.plain, '(?:^|[^{_CJK}·\\p{{Nd}}])(' || ok.name || '(?:{"|".join(tx.LEGAL_FORMS)}))', 1)) AS hit FROM ok JOIN pn ON pn.doc_id = ok.doc_id WHERE kind = 'company' AND NOT regexp_matches(ok.name, '(?:公司|事务所|合伙企业|合作社)$')),
fl AS (SELECT DISTINCT ok.doc_id, 'company' AS kind, coalesce((SELECT max_by(hit, (length(hit), hit)) FROM lf WHERE lf.doc_id = ok.doc_id AND lf.name = ok.name), ok.name) AS name FROM ok WHERE kind = 'company'),
{_found("fl", "first")},
al AS (SELECT DISTINCT doc_id, name FROM first),
us AS (SELECT * FROM al u WHERE NOT EXISTS (SELECT 1 FROM al o WHERE o.doc_id = u.doc_id AND length(o.name) > length(u.name) AND contains(o.name, u.name) AND NOT {_BRANCH})),
fin AS (SELECT doc_id, 'company' AS kind, name FROM us UNION ALL SELECT doc_id, kind, name FROM ok WHERE kind = 'person'),
{_found("fin", "hits")}"""


@query(f"WITH {co.NAME_PAGES}, {_ENTITIES} SELECT doc_id, page, kind, name, count(*) AS count FROM hits GROUP BY ALL")
def entity_hits(spark, sf_dir):
    """Where merged names stand, and how often, over pages that hold no lookalikes; snippets are in entity_merge."""
    return _merged(spark, sf_dir).select("doc_id", "page", "kind", "name", "count")


def _merged(spark, sf_dir):
    pages = co.name_pages(spark, sf_dir)
    raw = names.heuristic_names(pages).select("doc_id", "kind", "name", F.col("page").alias("ord"))
    return align.merge_entities(pages, raw)


@query()
def entity_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("doc_id", "page", "kind", "name", "count", F.array_join("origin_text", " | ").alias("origin_text"))


# Facts, roll-ups, rules, scores

_HITS = f"hi AS (SELECT event_id % 60 AS doc_id, (event_id % 7 + 1)::INTEGER AS page, CASE WHEN user_id % 2 = 0 THEN 'person' ELSE 'company' END AS kind, '星河' || user_id % 13 || '有限公司' AS name, user_id % 4 - 1 AS count, event_id AS ord FROM events)"


def _hits(spark, sf_dir):
    return co.table(spark, sf_dir, "events").select(
        F.expr("event_id % 60").alias("doc_id"), F.expr("cast(event_id % 7 + 1 AS int)").alias("page"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'person' ELSE 'company' END").alias("kind"),
        F.expr("'星河' || user_id % 13 || '有限公司'").alias("name"), F.expr("user_id % 4 - 1").alias("count"), F.col("event_id").alias("ord"), F.array(F.lit("text")).alias("origin_text"),
    )


@query(f"WITH {_HITS} SELECT doc_id, kind, name, sum(greatest(count, 1))::BIGINT AS count, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM hi GROUP BY doc_id, kind, name")
def hits_rollup(spark, sf_dir):
    return assemble.roll_up_hits(_hits(spark, sf_dir)).withColumn("pages", F.array_join("pages", ","))


@query(f"""WITH {_HITS}, c AS (SELECT doc_id, kind, name, sum(greatest(count, 1))::BIGINT AS count FROM hi GROUP BY ALL)
SELECT doc_id, kind, name, count, (row_number() OVER (PARTITION BY doc_id, kind ORDER BY count DESC, name))::INTEGER AS place FROM c""")
def ranked_names(spark, sf_dir):
    return assemble.ranked(assemble.roll_up_hits(_hits(spark, sf_dir))).drop("pages")


@query(f"WITH {_HITS} SELECT doc_id, page, kind, name, count, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind, name ORDER BY ord) AS n FROM hi) WHERE n = 1")
def page_first_wins(spark, sf_dir):
    return assemble.first_on_page(_hits(spark, sf_dir)).select("doc_id", "page", "kind", "name", "count", "ord")


@query(f"""WITH {_HITS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind, name ORDER BY ord) AS n FROM hi) WHERE n = 1)
SELECT doc_id, page, kind, name, greatest(count, 1)::BIGINT AS count FROM f""")
def rules_nested(spark, sf_dir):
    return assemble.flat_hits(assemble.page_rules(assemble.first_on_page(_hits(spark, sf_dir))))


@query(f"WITH {_HITS}, n AS (SELECT doc_id, page, count(DISTINCT (kind, name)) AS items FROM hi GROUP BY ALL) SELECT doc_id, page, items, doc_id % 3 = 0 AS prebuilt FROM n WHERE (doc_id % 3 = 0 AND page % 2 = 0) OR doc_id % 3 <> 0")
def rules_mode_switch(spark, sf_dir):
    derived = assemble.page_rules(assemble.first_on_page(_hits(spark, sf_dir)))
    prebuilt = derived.filter("doc_id % 3 = 0 AND page % 2 = 0")
    out = assemble.prebuilt_or_derived(prebuilt, derived)
    items = F.aggregate(assemble.with_items(F.col("rule_list")), F.lit(0).cast("long"), lambda a, r: a + F.size(r["items"]))
    return out.select("doc_id", "page", items.alias("items"), (F.col("doc_id") % 3 == 0).alias("prebuilt"))


@query("SELECT doc_id, sha256(string_agg(page || chr(10) || text || chr(10), '' ORDER BY page)) AS sha256 FROM (" + f"WITH {co.TURN_PAGES} SELECT * FROM tp) GROUP BY doc_id")
def text_sha256(spark, sf_dir):
    return assemble.text_hash(co.turn_pages(spark, sf_dir))


_SCORES = f"""{_HITS}, g AS (SELECT DISTINCT doc_id, kind, name FROM hi WHERE ord % 3 > 0), f AS (SELECT DISTINCT doc_id, kind, name FROM hi WHERE ord % 5 > 0 AND doc_id % 9 > 0),
b AS (SELECT coalesce(g.kind, f.kind) AS kind, coalesce(g.doc_id, f.doc_id) AS doc_id, g.name AS gn, f.name AS fn FROM g FULL JOIN f ON g.doc_id = f.doc_id AND g.kind = f.kind AND g.name = f.name),
c AS (SELECT kind, doc_id, count(*) FILTER (gn IS NOT NULL AND fn IS NOT NULL) AS tp, count(*) FILTER (gn IS NULL) AS fp, count(*) FILTER (fn IS NULL) AS fn FROM b GROUP BY kind, doc_id),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM c)"""


@query(f"WITH {_SCORES} SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p")
def prf1_score(spark, sf_dir):
    """Hits against hits: gold and found leave out different ones, so that both kinds of error occur."""
    h = _hits(spark, sf_dir)
    return assemble.scores(h.filter("ord % 3 > 0"), h.filter("ord % 5 > 0 AND doc_id % 9 > 0"), "kind", "doc_id")


@query("""SELECT event_type AS engine, count(*) AS pages, round(sum(value), 3) AS total_ms, round(avg(value), 3) AS mean_ms, sum(length(props))::BIGINT AS chars, count(*) FILTER (user_id % 10 = 0) AS errors FROM events GROUP BY event_type""")
def compare_totals(spark, sf_dir):
    e = co.table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("ocr_ms"), F.col("props").alias("text"), F.when(F.col("user_id") % 10 == 0, "failed").alias("error"))
    return assemble.compare_totals(e)


@query(f"""WITH {_HITS}, r AS (SELECT *, CASE WHEN kind = 'person' THEN 'B04' ELSE 'B06' END AS code FROM hi), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, code, name ORDER BY ord) AS n FROM r)
SELECT doc_id, page, code AS rule_code, name, CASE WHEN count > 0 THEN count ELSE 2 END::BIGINT AS count, repeat('x', 100) || '|y' AS origin_text FROM f WHERE n = 1""")
def rules_sanitized(spark, sf_dir):
    said = F.array(F.repeat(F.lit("x"), 120), F.lit("y"))
    h = _hits(spark, sf_dir).withColumns({"rule_code": F.expr("CASE WHEN kind = 'person' THEN ' b04' ELSE 'B06 ' END"), "origin_text": said})
    return assemble.sanitized(h).select("doc_id", "page", "rule_code", "name", "count", F.array_join("origin_text", "|").alias("origin_text"))


@query(f"""WITH {co.TURN_PAGES}, {_HITS}, l AS (SELECT doc_id, page, max(ord) AS ord FROM hi GROUP BY ALL) SELECT tp.doc_id, tp.page, l.ord AS rule FROM tp LEFT JOIN l ON l.doc_id = tp.doc_id AND l.page = tp.page""")
def page_rule_join(spark, sf_dir):
    rules = _hits(spark, sf_dir).select("doc_id", "page", "ord", F.col("ord").alias("rule_list"))
    return assemble.attach_rules(co.turn_pages(spark, sf_dir), rules).select("doc_id", "page", F.col("rule_list").alias("rule"))


@query(f"""WITH {_HITS}, s AS (SELECT doc_id, page, kind, name, min(ord) AS o FROM hi WHERE ord % 3 = 0 GROUP BY ALL)
SELECT hi.doc_id, hi.page, hi.kind, hi.name, ord, CASE WHEN ord % 2 = 0 THEN 'own' WHEN o IS NOT NULL THEN 'found ' || o ELSE '' END AS origin_text FROM hi LEFT JOIN s USING (doc_id, page, kind, name)""")
def origin_fill(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumn("origin_text", F.when(F.col("ord") % 2 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")))
    s = h.filter("ord % 3 = 0").groupBy("doc_id", "page", "kind", "name").agg(F.array(F.concat(F.lit("found "), F.min("ord"))).alias("origin_text"))
    return assemble.fill_origins(h, s).select("doc_id", "page", "kind", "name", "ord", F.array_join("origin_text", "|").alias("origin_text"))


_CODE = "repeat(' ', CAST(o_orderkey % 3 AS INT)) || substr('bBcb', CAST(o_orderkey % 4 + 1 AS INT), 1) || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '0' END || CAST(o_orderkey % 9 AS STRING) || repeat(' ', CAST(o_orderkey % 2 AS INT))"


@query(f"SELECT o_orderkey, upper(trim(code)) AS rule_code FROM (SELECT o_orderkey, {_CODE} AS code FROM orders) WHERE upper(trim(code)) IN ('B04', 'B06')")
def rule_code_filter(spark, sf_dir):
    return assemble.known_rules(co.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CODE).alias("rule_code")))


#: Hits as replies have them, in both dialects, by a number h: strings, pairs, objects with aliases, and what is none of them.
_REPLY_HITS = (
    "'\"Acme ' || CAST(h % 5 AS STRING) || '\"'", "'[\"Bolt\", 3]'", "'[\"Cog\", \"2\"]'", "'{\"n\": \"Dyn // x\", \"c\": 4}'", "'{\"companyName\": \" Eve /* y */ \", \"count\": \"5\"}'", "'5'", "'null'",
    "'[\"F\", 2.7]'", "'[ ]'", "'{\"count\": 2}'", "'[\"G\", \"2.5\"]'", "'[7, -1]'", "'{\"name\": null, \"person\": \"H\"}'", "'\" \"'", "'true'", "'[[\"I\"], 2]'", "'{\"person\": \"J, ]\", \"count\": [1]}'",
)


def _reply_hit(h: str) -> str:
    return f"CASE {h} % {len(_REPLY_HITS)} " + " ".join(f"WHEN {k} THEN {x.replace('h %', f'{h} %')}" for k, x in enumerate(_REPLY_HITS)) + " END"


_K = "o_orderkey"
_REPLY_PAGE = f"CASE {_K} % 8 WHEN 0 THEN '0' WHEN 1 THEN '\"3\"' WHEN 2 THEN '2.9' WHEN 3 THEN 'true' WHEN 4 THEN '\" 2.5\"' ELSE CAST({_K} % 9 + 1 AS STRING) END"
_REPLY_LIST = f"'[' || {_reply_hit(f'({_K} * 7 + 1)')} || ', ' || {_reply_hit(f'({_K} * 11 + 5)')} || ' , ]'"
_REPLY_BODY = f"""CASE {_K} % 7
  WHEN 0 THEN 'no json' WHEN 1 THEN '{{\"other\": [1]}}' WHEN 2 THEN '{{\"companies\": ' || {_REPLY_LIST} || ', \"persons\": 3,}}' WHEN 3 THEN '{{\"pages\": [ {{\"page\": ' || {_REPLY_PAGE} || ', \"companies\": ' || {_REPLY_LIST} || '}}, 4 ] }}'
  WHEN 4 THEN '{{\"p\": 3, \"persons\": ' || {_REPLY_LIST} || '}}'
  ELSE '{{\"p\": [ {{\"n\": ' || {_REPLY_PAGE} || ', \"c\": ' || {_REPLY_LIST} || ', \"r\": [' || {_reply_hit(f'({_K} * 3 + 2)')} || '] }}, /* , }} ] */ {{\"page\": 4, \"persons\": ' || {_REPLY_LIST} || ' , }} , ] , }} // end' END"""
_REPLY = f"CASE WHEN {_K} % 3 = 0 THEN '```json' || chr(10) ELSE 'so: ' END || {_REPLY_BODY} || CASE WHEN {_K} % 3 = 0 THEN chr(10) || '```' ELSE '' END"


def _json_count(v: str) -> str:
    """In DuckDB: a number cut to a whole one, or a whole number in a string; 0 for anything else."""
    n = f"CASE WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN ({v}->>'$')::DOUBLE WHEN json_type({v}) = 'VARCHAR' AND regexp_full_match(trim({v}->>'$'), '[+-]?\\d{{1,18}}') THEN trim({v}->>'$')::DOUBLE ELSE 0 END"
    return f"(CASE WHEN {n} > 0 THEN floor({n}) ELSE 0 END)::BIGINT"


_JSON_NAME = "CASE WHEN json_type(nv) = 'VARCHAR' THEN trim(nv->>'$') WHEN json_type(nv) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN nv->>'$' ELSE '' END"


@query(rf"""WITH r AS (SELECT o_orderkey AS doc_id, {_REPLY} AS raw FROM orders),
x AS (SELECT doc_id, regexp_replace(regexp_extract(raw, '(?s)\{{.*\}}'), '(?s)("(?:[^"\\]|\\.)*")|/\*.*?\*/|//[^\n]*', '\1', 'g') AS plain FROM r),
j AS (SELECT doc_id, TRY_CAST(nullif(regexp_replace(plain, '("(?:[^"\\]|\\.)*")|,(\s*[\]}}])', '\1\2', 'g'), '') AS JSON) AS v FROM x),
s AS (SELECT doc_id, v, CASE WHEN json_type(v->'$.p') = 'ARRAY' THEN 'compact' WHEN json_type(v->'$.pages') = 'ARRAY' THEN 'paged' WHEN json_type(v->'$.companies') = 'ARRAY' OR json_type(v->'$.persons') = 'ARRAY' THEN 'flat' END AS shape FROM j),
e AS (SELECT doc_id, shape, unnest(CASE shape WHEN 'compact' THEN from_json(v->'$.p', '["JSON"]') WHEN 'paged' THEN from_json(v->'$.pages', '["JSON"]') ELSE [v] END) AS e FROM s WHERE shape IS NOT NULL),
p AS (SELECT doc_id, shape, e, CASE WHEN shape <> 'flat' THEN {_json_count("coalesce(e->'$.n', e->'$.page')")} END AS page FROM e WHERE json_type(e) = 'OBJECT'),
l AS (SELECT doc_id, shape, page, x.kind, x.l FROM p, LATERAL (VALUES ('company', coalesce(e->'$.c', e->'$.companies')), ('person', coalesce(e->'$.r', e->'$.persons'))) x(kind, l) WHERE (shape = 'flat' OR page > 0) AND json_type(x.l) = 'ARRAY'),
i AS (SELECT doc_id, shape, page, kind, unnest(from_json(l, '["JSON"]')) AS i FROM l),
h AS (SELECT *, CASE json_type(i) WHEN 'VARCHAR' THEN i WHEN 'ARRAY' THEN i->0 WHEN 'OBJECT' THEN coalesce({", ".join(f"i->'$.{k}'" for k in replies.NAME_KEYS)}) END AS nv, CASE json_type(i) WHEN 'ARRAY' THEN i->1 WHEN 'OBJECT' THEN coalesce(i->'$.c', i->'$.count') END AS cv FROM i)
SELECT doc_id, shape, page, kind, {_JSON_NAME} AS name, greatest(coalesce({_json_count("cv")}, 1), 1)::BIGINT AS count FROM h WHERE {_JSON_NAME} <> ''""")
def json_lenient(spark, sf_dir):
    """Replies of many shapes, with fences, comments, trailing commas and odd items, as facts."""
    o = co.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_REPLY).alias("raw"))
    return replies.reply_facts(o)


@query(f"WITH {_HITS} SELECT doc_id, page, kind, name FROM hi WHERE page IN (SELECT DISTINCT 2 * (doc_id % 3 + 1))")
def assigned_pages(spark, sf_dir):
    h = _hits(spark, sf_dir)
    mine = h.select("doc_id", F.expr("cast(2 * (doc_id % 3 + 1) AS int)").alias("page"))
    return replies.assigned_only(h, mine).select("doc_id", "page", "kind", "name")


# Events

@query(f"WITH {co.NODE_EVENTS} SELECT job, page, node, ts FROM (SELECT *, row_number() OVER (PARTITION BY job, page ORDER BY ts, seq) AS n FROM ne WHERE kind = 'commit') WHERE n = 1")
def first_commit_wins(spark, sf_dir):
    return schedule.first_commits(co.node_events(spark, sf_dir))


@query(f"""WITH {co.NODE_EVENTS}, c AS (SELECT *, EXISTS (SELECT 1 FROM ne k WHERE k.kind = 'claim' AND k.job = ne.job AND k.page = ne.page AND k.node = ne.node AND (k.ts, k.seq) < (ne.ts, ne.seq)) AS live FROM ne WHERE kind = 'commit'),
r AS (SELECT *, row_number() OVER (PARTITION BY job, page, live ORDER BY ts, seq) AS n FROM c) SELECT seq, live AND n = 1 AS accepted FROM r""")
def commit_verdicts(spark, sf_dir):
    return schedule.commit_verdicts(co.node_events(spark, sf_dir)).select("seq", "accepted")


_LEASES = "ls AS (SELECT seq, job, page, node, ts AS created, least(greatest(1000, page * 90000), 500000)::BIGINT AS lease_ms FROM ne WHERE kind = 'claim')"


def _leases(spark, sf_dir):
    e = co.node_events(spark, sf_dir).filter("kind = 'claim'")
    lease = schedule.lease_ms(F.col("page"), F.lit(90_000), F.lit(1000), F.lit(500_000)).cast("long")
    return e.select("seq", "job", "page", "node", F.col("ts").alias("created"), lease.alias("lease_ms"))


@query(f"WITH {co.NODE_EVENTS}, {_LEASES} SELECT seq, lease_ms FROM ls")
def lease_duration(spark, sf_dir):
    return _leases(spark, sf_dir).select("seq", "lease_ms")


@query(f"""WITH {co.NODE_EVENTS}, {_LEASES} SELECT seq, job, page FROM ls WHERE created + to_milliseconds(lease_ms) <= TIMESTAMP '2024-01-20 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM ne WHERE kind = 'commit' AND ne.seq % 40 = 1 AND ne.job = ls.job AND ne.page = ls.page)""")
def lease_expired(spark, sf_dir):
    """Leases that ran out by a fixed moment; the commits of every fortieth event stand for the pages that are done."""
    done = co.node_events(spark, sf_dir).filter("kind = 'commit' AND seq % 40 = 1")
    return schedule.expired(_leases(spark, sf_dir), done, F.expr("timestamp '2024-01-20 00:00:00'")).select("seq", "job", "page")


@query(f"""WITH {co.NODE_EVENTS}, {_LEASES}, h AS (SELECT job, page, min(created) AS created, count(DISTINCT node) AS holders FROM ls WHERE NOT EXISTS (SELECT 1 FROM ne WHERE kind = 'commit' AND ne.job = ls.job AND ne.page = ls.page AND ne.seq % 40 = 1) GROUP BY job, page)
SELECT job, page, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY created, page) AS place FROM h WHERE holders < 12) WHERE place <= 2""")
def speculative_copies(spark, sf_dir):
    """Second copies of pages; the commits of every fortieth event stand for the pages that are done."""
    done = co.node_events(spark, sf_dir).filter("kind = 'commit' AND seq % 40 = 1")
    return schedule.speculative(_leases(spark, sf_dir), done, 2, 12).select("job", "page", "place")


@query("SELECT o_custkey AS job, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS leased, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def schedule_snapshot(spark, sf_dir):
    state = F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'leased' WHEN 'P' THEN 'pending' END")
    return schedule.snapshot(co.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), state.alias("state")))


@query(f"""WITH {co.NODE_EVENTS}, t AS (SELECT DISTINCT job, 8 + job % 3 AS total FROM ne), g AS (SELECT job, unnest(range(1, total + 1))::INTEGER AS page FROM t)
SELECT t.job, (SELECT min(page) FROM g WHERE g.job = t.job AND NOT EXISTS (SELECT 1 FROM ne WHERE kind = 'commit' AND ne.seq % 30 = 6 AND ne.job = g.job AND ne.page = g.page)) AS missing FROM t""")
def earliest_missing(spark, sf_dir):
    """The commits of some events stand for the pages that are done, so that jobs have gaps; all jobs are asked for."""
    e = co.node_events(spark, sf_dir)
    return schedule.earliest_missing(e.select("job", (8 + F.col("job") % 3).alias("total")).distinct(), e.filter("kind = 'commit' AND seq % 30 = 6"))


@query(f"""WITH {co.NODE_EVENTS}, n AS (SELECT node, count(*) AS pages, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM ne WHERE kind = 'commit' GROUP BY node),
r AS (SELECT *, CASE WHEN seconds > 0 THEN round(pages / seconds, 6) END AS pages_per_s FROM n)
SELECT *, coalesce(least(greatest(round_even(pages_per_s * 8, 0), 1), 16), 2)::INTEGER AS batch FROM r""")
def node_rate(spark, sf_dir):
    return schedule.node_rates(co.node_events(spark, sf_dir).filter("kind = 'commit'"))


@query(f"WITH {co.NODE_EVENTS}, n AS (SELECT job, node, count(*) AS n FROM ne WHERE kind = 'commit' GROUP BY job, node) SELECT job, string_agg(node || '=' || n, ', ' ORDER BY node) AS nodes FROM n GROUP BY job")
def node_totals(spark, sf_dir):
    return schedule.node_list(co.node_events(spark, sf_dir).filter("kind = 'commit'"))


@query(f"""WITH {co.NODE_EVENTS}, d AS (SELECT job, seq, ts, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS done, 30 AS total FROM ne WHERE kind = 'commit'),
b AS (SELECT *, floor(done * 100 / total / 10)::INTEGER AS bucket FROM d), l AS (SELECT *, coalesce(lag(bucket) OVER (PARTITION BY job ORDER BY ts, seq), 0) AS before FROM b)
SELECT job, seq, done::INTEGER AS done, bucket FROM l WHERE bucket >= 1 AND bucket > before AND done < total""")
def progress_bucket(spark, sf_dir):
    e = co.node_events(spark, sf_dir).filter("kind = 'commit'").withColumn("total", F.lit(30))
    return schedule.progress_lines(e).select("job", "seq", "done", "bucket")


@query(f"WITH {co.INTERVALS} SELECT stage, count(*) AS n, sum(stop_ms - start_ms)::BIGINT AS sum_ms, max(stop_ms) - min(start_ms) AS wall_ms FROM iv GROUP BY stage")
def wall_span(spark, sf_dir):
    return schedule.wall_span(co.intervals(spark, sf_dir), "stage")


@query(f"""WITH {co.INTERVALS}, e AS (SELECT stage, start_ms AS tm, 1 AS d FROM iv UNION ALL SELECT stage, stop_ms, -1 FROM iv), g AS (SELECT stage, tm, d, sum(d) AS s FROM e GROUP BY ALL),
o AS (SELECT stage, sum(s) OVER (PARTITION BY stage ORDER BY tm, d) AS n FROM g) SELECT stage, max(n)::BIGINT AS peak FROM o GROUP BY stage""")
def peak_concurrency(spark, sf_dir):
    return schedule.peak_concurrency(co.intervals(spark, sf_dir), "stage", width_ms=1000)


@query(f"""WITH {co.NODE_EVENTS}, f AS (SELECT seq, (sum(CASE WHEN kind IN ('fail', 'expire', 'drop') THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY ts, seq))::BIGINT AS failures FROM ne) SELECT *, failures >= 8 AS gave_up FROM f""")
def running_failures(spark, sf_dir):
    return schedule.attempts(co.node_events(spark, sf_dir)).select("seq", "failures", "gave_up")


@query(f"""WITH {co.NODE_EVENTS}, l AS (SELECT *, last_value(CASE WHEN kind = 'fail' THEN node END IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failer FROM ne) SELECT seq, group_id, node FROM l WHERE kind = 'claim' AND failer = node""")
def last_failer(spark, sf_dir):
    return schedule.same_failer(co.node_events(spark, sf_dir)).select("seq", "group_id", "node")


#: Of an event, in both dialects: what a node's health is learned from; every eleventh event's heartbeat says that the node is down.
_HEALTH_KIND = "CASE kind WHEN 'fail' THEN 'fail' WHEN 'expire' THEN 'fail' WHEN 'commit' THEN 'ok' ELSE 'heartbeat' END"


def _health(spark, sf_dir):
    return co.node_events(spark, sf_dir).select("node", "ts", "seq", F.expr(_HEALTH_KIND).alias("kind"), F.expr("seq % 11 > 0").alias("up"))


_HEALTH = f"{co.NODE_EVENTS}, he AS (SELECT node, ts, seq, {_HEALTH_KIND} AS kind, seq % 11 > 0 AS up FROM ne)"


@query(f"""WITH {_HEALTH},
a AS (SELECT h.*, b.ts AS beat FROM he h ASOF LEFT JOIN (SELECT node, ts FROM he WHERE kind = 'heartbeat') b ON h.node = b.node AND h.ts >= b.ts),
r AS (SELECT *, sum(CASE WHEN kind = 'fail' THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY ts, seq) AS run FROM a),
m AS (SELECT *, (sum(CASE WHEN kind = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY node, run ORDER BY ts, seq))::BIGINT AS missed,
  first_value(CASE WHEN kind = 'heartbeat' THEN up ELSE true END) OVER (PARTITION BY node, run ORDER BY ts, seq) AS was FROM r)
SELECT seq, missed, was AND NOT (missed >= 2 AND NOT coalesce(ts - beat <= INTERVAL 20 MINUTE, false)) AS healthy FROM m""")
def liveness_runs(spark, sf_dir):
    return schedule.liveness(_health(spark, sf_dir), fresh_ms=20 * 60_000).select("seq", "missed", "healthy")


@query(f"""WITH {_HEALTH}
SELECT p.seq, CASE WHEN p.ts - b.ts <= INTERVAL 30 MINUTE THEN b.seq END AS heartbeat FROM (SELECT * FROM he WHERE kind <> 'heartbeat') p
ASOF LEFT JOIN (SELECT node, ts, seq FROM he WHERE kind = 'heartbeat') b ON p.node = b.node AND p.ts >= b.ts""")
def as_of_heartbeat(spark, sf_dir):
    """Of heartbeats of one moment that with the largest seq, where the SQL may take any."""
    h = _health(spark, sf_dir)
    beats = h.filter("kind = 'heartbeat' AND node IS NOT NULL")
    return schedule.as_of(h.filter("kind <> 'heartbeat'"), beats, "node", within_ms=30 * 60_000, by_ts=True).select("seq", F.col("mark.seq").alias("heartbeat"))


_NODES = "nd AS (SELECT s_nationkey AS job, s_suppkey AS node, (s_suppkey % 6)::INTEGER AS in_flight, (s_suppkey % 5 + 2)::INTEGER AS capacity, s_suppkey % 4 > 0 AS active, s_suppkey % 7 > 0 AS healthy, (s_nationkey % 20)::INTEGER AS remaining, (s_suppkey % 3)::INTEGER AS sessions FROM supplier)"


def _nodes(spark, sf_dir):
    return co.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("job"), F.col("s_suppkey").alias("node"), F.expr("cast(s_suppkey % 6 AS int)").alias("in_flight"), F.expr("cast(s_suppkey % 5 + 2 AS int)").alias("capacity"),
        F.expr("s_suppkey % 4 > 0").alias("active"), F.expr("s_suppkey % 7 > 0").alias("healthy"), F.expr("cast(s_nationkey % 20 AS int)").alias("remaining"), F.expr("cast(s_suppkey % 3 AS int)").alias("sessions"),
    )


@query(f"WITH {_NODES}, m AS (SELECT *, min(CASE WHEN active AND in_flight < capacity THEN in_flight / capacity END) OVER (PARTITION BY job) AS low FROM nd) SELECT job, node, coalesce(low < in_flight / capacity, false) AS yields FROM m")
def fair_dispatch(spark, sf_dir):
    return schedule.must_yield(_nodes(spark, sf_dir)).select("job", "node", "yields")


@query(f"WITH {_NODES} SELECT job, max(remaining) < sum(CASE WHEN healthy THEN greatest(capacity - in_flight, 0) ELSE 0 END) AS has_room FROM nd GROUP BY job")
def room_test(spark, sf_dir):
    return schedule.room(_nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, o AS (SELECT *, CASE WHEN active THEN 'ocr' WHEN healthy AND remaining > 0 THEN 'ner' END AS offer FROM nd)
SELECT job, node, offer, (row_number() OVER (PARTITION BY job ORDER BY CASE WHEN offer = 'ocr' THEN 0 ELSE 1 END, in_flight, node))::INTEGER AS place FROM o WHERE sessions < 2 AND offer IS NOT NULL""")
def dispatch_order(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumns({"ocr_open": F.col("active"), "can_ner": F.col("healthy"), "ner_pending": F.col("remaining")})
    return schedule.dispatch(n).select("job", "node", "offer", "place")


@query(f"""WITH k AS (SELECT s_nationkey AS pool, s_suppkey AS key, s_suppkey % 3 AS in_use, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT pool, key FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY in_use, ((idx - 2) % n + n) % n) AS r FROM k) WHERE r = 1""")
def least_loaded(spark, sf_dir):
    from pyspark.sql import Window

    s = co.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("key"), F.expr("s_suppkey % 3").alias("in_use"))
    return schedule.least_loaded(s.withColumn("idx", F.row_number().over(Window.partitionBy("pool").orderBy("key")) - 1), F.lit(2))


@query("""SELECT event_id, CASE WHEN st IS NULL THEN 'retry' WHEN st = 401 THEN 'disable-key' WHEN st IN (403, 408, 429) OR st >= 500 THEN 'retry' WHEN st >= 400 THEN 'fail' WHEN user_id % 2 = 0 THEN 'done' ELSE 'correct' END AS next,
  least(2000, 200 * pow(2, least(user_id % 8 + 1 - 1, 4)))::INTEGER AS wait_ms
FROM (SELECT event_id, user_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 404 WHEN 5 THEN 503 ELSE 200 END AS st FROM events)""")
def retry_classify(spark, sf_dir):
    e = co.table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 404 WHEN 5 THEN 503 ELSE 200 END").alias("st"))
    return e.select("event_id", schedule.retry_kind(F.col("st"), F.col("user_id") % 2 == 0).alias("next"), schedule.backoff_ms((F.col("user_id") % 8 + 1).cast("int")).alias("wait_ms"))


@query("""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cpu' ELSE 'GPU' END AS mode, CASE WHEN s_suppkey % 3 = 0 THEN 'Small' ELSE 'small' END AS model, CASE WHEN s_suppkey % 5 = 0 THEN 96 ELSE 130 END AS dpi FROM supplier),
c AS (SELECT 'gpu' AS mode, 'small' AS model, 130 AS dpi)
SELECT n.s_suppkey, concat_ws('; ', CASE WHEN lower(n.mode) <> lower(c.mode) THEN 'mode differs' END, CASE WHEN n.model <> c.model THEN 'model differs' END, CASE WHEN n.dpi <> c.dpi THEN 'dpi differs' END) AS differs FROM n, c""")
def node_compatibility(spark, sf_dir):
    k = F.col("s_suppkey")
    differs = schedule.node_compatibility(
        (F.when(k % 2 == 0, "cpu").otherwise("GPU"), F.lit("gpu")), (F.when(k % 3 == 0, "Small").otherwise("small"), F.lit("small")), (F.when(k % 5 == 0, 96).otherwise(130), F.lit(130)))
    return co.table(spark, sf_dir, "supplier").select("s_suppkey", differs.alias("differs"))


@query()
def lease_replay(spark, sf_dir):
    kind = F.expr("CASE WHEN seq % 101 = 4 THEN 'takeover' WHEN kind = 'expire' THEN 'reap' WHEN kind = 'fail' THEN 'drop' ELSE kind END")
    e = co.node_events(spark, sf_dir).withColumns({"capacity": F.lit(3), "total": F.lit(40), "blocker": F.expr("CASE WHEN seq % 3 = 0 THEN page END"), "kind": kind})
    return leases.replay(e).withColumn("pages", F.array_join("pages", ","))


@query(f"""WITH {co.NODE_EVENTS}, k AS (SELECT node, count(*) AS pages, max(ts) AS seen FROM ne WHERE kind = 'claim' AND node < 9 GROUP BY node), h AS (SELECT node, count(*) AS pages, max(ts) AS seen FROM ne WHERE kind = 'commit' AND node > 4 GROUP BY node)
SELECT coalesce(k.node, h.node) AS node, coalesce(h.pages, k.pages) AS pages, greatest(h.seen, k.seen) AS seen FROM k FULL JOIN h ON k.node = h.node""")
def node_upsert(spark, sf_dir):
    """What was known are the claims of some nodes, what was heard the commits of others, so that some nodes are in one only."""
    e = co.node_events(spark, sf_dir)
    per = lambda df: df.groupBy("node").agg(F.count("*").alias("pages"), F.max("ts").alias("seen"))
    return schedule.upserted(per(e.filter("kind = 'claim' AND node < 9")), per(e.filter("kind = 'commit' AND node > 4")))


@query(f"""WITH RECURSIVE {co.NODE_EVENTS}, d AS (SELECT job, epoch_us(ts) // 20000000 AS ms, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS done FROM ne WHERE kind = 'commit'),
w(job, i, last_ms, last_done, bucket, ms, said) AS (
  SELECT DISTINCT job, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, false FROM d
  UNION ALL
  SELECT job, done, CASE WHEN say THEN n_ms ELSE last_ms END, CASE WHEN say THEN done ELSE last_done END, CASE WHEN say THEN done * 10 // 60 ELSE bucket END, n_ms, say
  FROM (SELECT w.job, d.done, d.ms AS n_ms, w.last_ms, w.last_done, w.bucket,
               d.done <> w.last_done AND d.done < 60 AND (w.last_ms IS NULL OR (d.ms - w.last_ms >= 1000 AND (d.ms - w.last_ms >= 3000 OR d.done * 10 // 60 > w.bucket))) AS say
        FROM w JOIN d ON d.job = w.job AND d.done = w.i + 1))
SELECT job, ms, i::INTEGER AS done FROM w WHERE said""")
def progress_log(spark, sf_dir):
    e = co.node_events(spark, sf_dir).filter("kind = 'commit'")
    from pyspark.sql import Window

    done = F.row_number().over(Window.partitionBy("job").orderBy("ts", "seq"))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20_000_000).cast("long")  # twenty thousand times as fast, so that lines come close
    return schedule.progress_log(e.select("job", ms.alias("ms"), done.alias("done"), F.lit(60).alias("total")))


# Sources and sinks

_REFS = r"""rf AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '../etc' WHEN 1 THEN 'a' || p_partkey WHEN 2 THEN 'b' || p_partkey || '.tif' WHEN 3 THEN '' WHEN 4 THEN 'c:d' WHEN 5 THEN ' e' || p_partkey || ' ' WHEN 6 THEN 'f\g' ELSE 'h' || p_partkey END AS file_id,
  CASE p_partkey % 3 WHEN 0 THEN 'https://x.org/' || p_partkey WHEN 1 THEN 'ftp://x' END AS url, CASE WHEN p_partkey % 2 = 0 THEN '/data' END AS root FROM part)"""
_SAFE = r"CASE WHEN length(trim(file_id)) BETWEEN 1 AND 180 AND NOT contains(file_id, '..') AND NOT regexp_matches(trim(file_id), '[/\\:\x00-\x1f\x7f]') AND trim(file_id) <> '.' THEN CASE WHEN contains(file_id, '.') THEN trim(file_id) ELSE trim(file_id) || '.pdf' END END"


def _refs(spark, sf_dir):
    k = F.col("p_partkey")
    file_id = (
        F.when(k % 8 == 0, "../etc").when(k % 8 == 1, F.concat(F.lit("a"), k)).when(k % 8 == 2, F.concat(F.lit("b"), k, F.lit(".tif"))).when(k % 8 == 3, "")
        .when(k % 8 == 4, "c:d").when(k % 8 == 5, F.concat(F.lit(" e"), k, F.lit(" "))).when(k % 8 == 6, "f\\g").otherwise(F.concat(F.lit("h"), k))
    )
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x.org/"), k)).when(k % 3 == 1, "ftp://x")
    return co.table(spark, sf_dir, "part").select("p_partkey", file_id.alias("file_id"), url.alias("url"), F.when(k % 2 == 0, "/data").alias("root"))


@query(f"WITH {_REFS} SELECT p_partkey, {_SAFE} AS name FROM rf")
def path_safety(spark, sf_dir):
    return _refs(spark, sf_dir).select("p_partkey", files.safe_name(F.col("file_id")).alias("name"))


@query(f"""WITH {_REFS}, a AS (SELECT * FROM rf WHERE trim(file_id) <> '' AND (root IS NOT NULL OR url LIKE 'https:%')), n AS (SELECT *, CASE WHEN url LIKE 'https:%' THEN url END AS web, {_SAFE} AS name FROM a)
SELECT file_id, web AS url, root, CASE WHEN root IS NOT NULL AND p_partkey % 5 = 0 AND name IS NOT NULL THEN 'local' WHEN web IS NOT NULL THEN 'remote' ELSE 'missing' END AS kind,
  CASE WHEN root IS NOT NULL AND p_partkey % 5 = 0 AND name IS NOT NULL THEN root || '/' || name WHEN web IS NOT NULL THEN web END AS place FROM n""")
def source_resolution(spark, sf_dir):
    r = files.accepted_refs(_refs(spark, sf_dir))
    listing = _refs(spark, sf_dir).filter("p_partkey % 5 = 0").select(F.lit("/data").alias("root"), files.safe_name(F.col("file_id")).alias("name")).filter("name IS NOT NULL")
    return files.resolve_refs(r, listing)


@query("""WITH n AS (SELECT p_partkey, (p_partkey * 1000003 % 30000000)::BIGINT AS length FROM part), k AS (SELECT *, greatest(1, least(8, length // 1048576)) AS n FROM n), r AS (SELECT *, unnest(range(0, n)) AS part FROM k)
SELECT p_partkey AS file_id, part::INTEGER AS part, (length * part) // n AS start, (length * (part + 1)) // n - 1 AS stop FROM r""")
def download_ranges(spark, sf_dir):
    return files.byte_ranges(co.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.expr("p_partkey * 1000003 % 30000000").alias("length")))


@query(f"WITH {co.TURN_PAGES} SELECT doc_id, page, length(text)::BIGINT AS chars, length(text) > 100 AS truncated, left(text, 100) AS text FROM tp")
def trace_truncate(spark, sf_dir):
    t = files.trace_pages(co.turn_pages(spark, sf_dir), 100)
    j = F.from_json("value", "struct<chars:bigint,truncated:boolean,text:string>")
    return t.withColumn("j", j).select("doc_id", "page", "j.chars", "j.truncated", "j.text")


# Streams that play a table: what comes out once the watermark has reached the end of the input.

_LEASE_MS = 3 * 3_600_000
_DELAY_MS = 600_000


@query(f"""WITH {co.NODE_EVENTS},
x AS (SELECT job, page, node, epoch_us(ts) // 1000 AS tm, kind FROM ne WHERE kind IN ('claim', 'commit')),
c AS (SELECT * FROM x WHERE kind = 'claim'),
g AS (SELECT m.job, m.page, min(m.tm) AS done FROM x m JOIN c ON m.job = c.job AND m.page = c.page AND m.node = c.node AND c.tm <= m.tm AND m.tm < c.tm + {_LEASE_MS} WHERE m.kind = 'commit' GROUP BY ALL),
d AS (SELECT DISTINCT job, page, tm + {_LEASE_MS} AS at_ms FROM c)
SELECT d.job, d.page, d.at_ms FROM d LEFT JOIN g ON d.job = g.job AND d.page = g.page
WHERE d.at_ms <= (SELECT max(tm) - {_DELAY_MS} FROM x) AND (g.done IS NULL OR g.done > d.at_ms)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.job = d.job AND c.page = d.page AND c.tm <= d.at_ms AND d.at_ms < c.tm + {_LEASE_MS})""")
def lease_requeues(spark, sf_dir):
    events = co.as_node_events(play.table_stream(spark, f"{sf_dir}/events.parquet"))
    return play.played(lease_stream.requeues(events, _LEASE_MS, f"{_DELAY_MS} milliseconds", keep_ms=10**13), "requeues")


#: Of a conversation's turn, in both dialects: when it comes as a page, and whether and how much later it is classified.
_CAME = "1000000000000 + (conv_id * 40 + turn) * 1000"
_CLASSED = "CASE WHEN (conv_id * 7 + turn) % 5 > 0 THEN (conv_id * 13 + turn * 7) % 90 * 1000 END"


@query(f"""WITH t AS (SELECT conv_id AS doc_id, turn AS page, {_CAME} AS at_ms, {_CLASSED} AS later, (conv_id + turn) % 3 = 0 AS use_layer FROM conversations),
w AS (SELECT least((SELECT max(at_ms) FROM t), (SELECT max(at_ms + later) FROM t)) - 30000 AS mark)
SELECT doc_id, page, CASE WHEN later <= 60000 THEN use_layer END AS use_layer FROM t WHERE later <= 60000 OR at_ms + 60000 < (SELECT mark FROM w)""")
def deferred_admission(spark, sf_dir):
    """Pages show up once they are classified within a minute, the others after it."""
    turns = lambda: play.table_stream(spark, f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.expr(_CAME).alias("ms"), F.expr(_CLASSED).alias("later"))
    pages = turns().select("doc_id", "page", F.timestamp_millis("ms").alias("at"))
    classes = turns().filter("later IS NOT NULL").select("doc_id", "page", F.timestamp_millis(F.col("ms") + F.col("later")).alias("at"), F.expr("(doc_id + page) % 3 = 0").alias("use_layer"))
    return play.played(lease_stream.admitted(pages, classes, "60 seconds", "30 seconds").select("doc_id", "page", "use_layer"), "admitted")


@query(f"""WITH {co.TURN_PAGES}, g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 2 AS group_no FROM tp WHERE NOT {_blank("text")}),
h AS (SELECT doc_id, group_no, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages, arg_min(text, page) AS first FROM g GROUP BY ALL),
n AS (SELECT *, lead(first) OVER (PARTITION BY doc_id ORDER BY group_no) AS next FROM h),
w AS (SELECT max({_CAME}) - 30000 AS mark FROM conversations),
e AS (SELECT conv_id AS doc_id, max({_CAME}) + 20000 <= (SELECT mark FROM w) AS sealed FROM conversations GROUP BY conv_id)
SELECT doc_id, group_no::INTEGER AS group_no, pages, left(next, 240) AS head FROM n JOIN e USING (doc_id) WHERE sealed OR next IS NOT NULL""")
def sealed_groups(spark, sf_dir):
    """Turns as pages in groups of two; a conversation ends when nothing of it came for 20 seconds."""
    turns = play.table_stream(spark, f"{sf_dir}/conversations.parquet").withColumn("at", F.timestamp_millis(F.expr(_CAME)))
    pages = co.as_turn_pages(turns, "at")
    made = page_stream.sealed_groups(pages, 2, 10**9, 20_000, 3_600_000, "30 seconds")
    return play.played(made.select("doc_id", "group_no", F.array_join("pages", ",").alias("pages"), "head"), "sealed")


# Files by byte ranges

_PAGE_BYTES = "SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n_bytes, sha256(coalesce(html, '')) AS sha256 FROM pages"


def _blobs(spark, sf_dir):
    """Blobs of all pages, and where each page lies in them."""
    at = shared(spark, "blobs")
    rows = co.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("data"))
    return ranged.write_blobs(rows, f"{at}/blobs", f"{at}/index"), f"{at}/blobs"


@query(_PAGE_BYTES)
def ranged_download(spark, sf_dir):
    """Blobs fetched range by range, and pages put together from the ranges they lie in."""
    index, folder = _blobs(spark, sf_dir)
    parts = ranged.ranged(spark, folder, least=1 << 16).select("file", F.col("start").alias("low"), F.col("stop").alias("high"), "data")
    empty = index.filter("length = 0").select("id", F.lit(0).cast("long").alias("low"), F.lit(b"").alias("piece"))
    first, last = F.greatest("start", "low"), F.least(F.col("start") + F.col("length") - 1, F.col("high"))
    met = index.filter("length > 0").join(parts, "file").filter((F.col("start") <= F.col("high")) & (F.col("start") + F.col("length") > F.col("low")))
    pieces = met.select("id", "low", F.substring("data", (first - F.col("low") + 1).cast("int"), (last - first + 1).cast("int")).alias("piece")).union(empty)
    whole = pieces.groupBy(F.col("id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("low", "piece"))).alias("p"))  # the ranges of one page
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    return whole.select("page_id", data.alias("data")).select("page_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


@query(f"SELECT *, n_bytes AS fetched FROM ({_PAGE_BYTES})")
def ranged_pages(spark, sf_dir):
    """Pages read from their own places in blobs; nothing else is fetched."""
    index, folder = _blobs(spark, sf_dir)
    found = ranged.read_places(index, folder)
    return found.select(F.col("id").alias("page_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"), "fetched")


@query(f"SELECT page_id, n_bytes AS length, sha256 FROM ({_PAGE_BYTES})")
def published_pages(spark, sf_dir):
    """Pages published as files, and adopted where the length is what was promised; a partial one isn't."""
    at = shared(spark, "published")
    pages = co.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("data")).withColumn("length", F.octet_length("data").cast("long"))
    publish.publish(pages.select(F.format_string("page-%d.pdf", "page_id").alias("name"), "data", "length"), at)
    listing = ranged.ranged(spark, at, parts=1, data="false").select(F.col("file").alias("name"), "length")
    jobs = files.adopted(listing, pages.select(F.format_string("page-%d", "page_id").alias("job_id"), "page_id", "length"))
    read = ranged.ranged(spark, at, parts=1).filter("mode = 'range'").select("file", F.sha2("data", 256).alias("sha256"))
    return jobs.join(read, F.col("file") == F.format_string("page-%d.pdf", "page_id")).select("page_id", "length", "sha256")


@query("""SELECT c_custkey::VARCHAR AS key, '{"customer":"' || c_name || '"}' AS body, least(c_custkey % 6 + 1, 4)::INTEGER AS attempts, c_custkey % 6 < 4 AS delivered,
  ([0, 500, 2500, 7000])[least(c_custkey % 6, 3) + 1]::BIGINT AS waited_ms FROM customer""")
def callback_attempts(spark, sf_dir):
    """Results posted to a receiver that refuses each one customer number % 6 times; waits are told, not slept."""
    at = shared(spark, "callbacks")
    publish.register_callbacks(spark, "flaky_callbacks", lambda key, body, n: n > int(key) % 6, wait=lambda ms: None)
    rows = co.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.col("c_name").alias("customer"))).alias("body"))
    rows.write.format("flaky_callbacks").option("path", at).mode("append").save()
    waited = F.aggregate("delays_ms", F.lit(0).cast("long"), lambda a, x: a + x)
    return publish.callback_results(spark, at).select("key", "body", "attempts", "delivered", waited.alias("waited_ms"))


# The same in SQL

@query(SQL["group_char_cap"])
def sql_group_pages(spark, sf_dir):
    sql.register(spark)
    sql.page_views(co.turn_pages(spark, sf_dir))
    return spark.sql("SELECT doc_id, group_no, array_join(pages, ',') AS pages FROM group_pages(TABLE(SELECT doc_id, page, text FROM doc_pages) PARTITION BY doc_id ORDER BY (page), 4, 2000)")


@query(SQL["page_spec_parse"])
def sql_page_ranges(spark, sf_dir):
    sql.register(spark)
    co.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SPEC).alias("spec")).createOrReplaceTempView("selections")
    return spark.sql("""
        SELECT c_custkey, spec, max(error) AS error, CASE WHEN count(start) > 0 THEN array_join(transform(array_sort(collect_list(CASE WHEN start IS NOT NULL THEN struct(start, stop) END)),
          r -> CASE WHEN r.start = r.stop THEN string(r.start) ELSE r.start || '-' || r.stop END), ',') END AS canonical
        FROM selections, LATERAL page_ranges(spec) GROUP BY c_custkey, spec""")


@query(rf"""WITH {co.SUPPLIER_PAGES} SELECT doc_id, page, {_blank("text")} AS blank, length(text)::BIGINT AS chars, length(regexp_replace(text, '[\s\v\x{{85}}\p{{Z}}]', '', 'g'))::BIGINT AS nonspace,
  translate(text, '{_WIDE}', '{_NARROW}') AS folded, '--- page ' || page || ' ---' || chr(10) || text || chr(10) AS block FROM sp""")
def sql_rules(spark, sf_dir):
    sql.register(spark)
    sql.page_views(co.supplier_pages(spark, sf_dir))
    return spark.sql("""
        SELECT p.doc_id, p.page, is_blank_page(text) AS blank, f.chars, f.nonspace, fold_text(text) AS folded, page_block(p.page, text) AS block
        FROM doc_pages p JOIN page_facts f ON p.doc_id = f.doc_id AND p.page = f.page""")


# Lookalikes: pages on which a company stands exactly, with one lookalike, or with two.

#: Of a customer, in both dialects: its company, and a page that names it in one of six ways.
_FIRM = "'东海技术' || CAST(c_custkey % 9 AS STRING) || '银行有限公司'"
_ONE = "'东海技木' || CAST(c_custkey % 9 AS STRING) || '银行有限公司'"
_OTHER = "'东海技术' || CAST(c_custkey % 9 AS STRING) || '很行有限公司'"
_TWO = "'东海技木' || CAST(c_custkey % 9 AS STRING) || '很行有限公司'"
_SEEN = f"""CASE c_custkey % 6 WHEN 0 THEN '甲方：' || {_FIRM} || '。' || {_ONE} WHEN 1 THEN {_ONE} || '，' || {_OTHER} || '；' || {_TWO} WHEN 2 THEN {_TWO} || chr(10) || {_TWO}
  WHEN 3 THEN '由 ' || {_OTHER} || ' 与 ' || {_OTHER} || ' 签' WHEN 4 THEN '无' ELSE '（' || {_FIRM} || '）' || {_FIRM} END"""


@query(f"""WITH t AS (SELECT c_custkey AS doc_id, {_FIRM} AS name, {_SEEN} AS text FROM customer),
n AS (SELECT doc_id, name, {_joined("text")} AS norm FROM t),
w AS (SELECT doc_id, name, list_transform(range(1, greatest(length(norm) - length(name) + 2, 1)), lambda i: norm[i:i + length(name) - 1]) AS windows FROM n),
d AS (SELECT doc_id, name, list_transform(windows, lambda x: list_filter(list_transform(range(1, length(name) + 1), lambda j: CASE WHEN x[j] <> name[j] THEN x[j] || name[j] END), lambda y: y IS NOT NULL)) AS apart FROM w),
k AS (SELECT doc_id, name, len(list_filter(apart, lambda a: len(a) = 0)) AS exact, len(list_filter(apart, lambda a: len(a) = 1 AND a[1] IN ({_PAIRS}))) AS near FROM d)
SELECT doc_id, name, CASE WHEN exact > 0 THEN exact ELSE near END AS count, exact > 0 AS exact FROM k WHERE exact + near > 0""")
def lookalike_hits(spark, sf_dir):
    """Companies where pages have them exactly, or else with one lookalike; two are none."""
    c = co.table(spark, sf_dir, "customer")
    pages = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(_SEEN).alias("text"))
    firms = c.select(F.col("c_custkey").alias("doc_id"), F.lit("company").alias("kind"), F.expr(_FIRM).alias("name"))
    return align.located(pages, firms).groupBy("doc_id", "name").agg(F.count("*").alias("count"), F.max("exact").alias("exact"))


# What a vision model says of pages: some names bare, some with spaces or wrong, a page in five without text.

#: Per page, rule code and place what is said: name and count, by c_custkey, in both dialects.
_RULES_SAID = (
    (1, "B06", 0, "'东海' || CAST(c_custkey % 7 AS STRING) || ' 有限公司'", "0"), (1, "B06", 1, "'东海' || CAST(c_custkey % 7 AS STRING) || '有限公司'", "5"), (1, "B06", 2, "'总公司'", "1"),
    (1, "B04", 3, "'张 伟先生'", "c_custkey % 3"), (1, "B04", 4, "'某某'", "1"), (2, "B04", 0, "'李娜'", "2"), (2, "B09", 1, "'王芳'", "1"), (2, "B06", 2, "''", "1"),
)
_RULES_SAID_SQL = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, {p}::INTEGER AS page, '{code}' AS rule_code, {ord_} AS ord, {name} AS name, {n} AS said FROM customer" for p, code, ord_, name, n in _RULES_SAID)
_SEEN_TEXT = "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE '东海' || CAST(c_custkey % 7 AS STRING) || '有限公司由张伟签。张伟' END"


def _said(spark, sf_dir):
    rows = [F.struct(F.lit(p).alias("page"), F.lit(code).alias("rule_code"), F.lit(o).alias("ord"), F.expr(name).alias("name"), F.expr(n).cast("long").alias("count")) for p, code, o, name, n in _RULES_SAID]
    said = co.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")
    return assemble.known_rules(said.withColumn("origin_text", F.array().cast("array<string>")))


@query(f"""WITH s AS ({_RULES_SAID_SQL}),
r AS (SELECT doc_id, page, rule_code, ord, said, CASE WHEN rule_code = 'B04' THEN regexp_replace({_repair("name")}, '先生$', '') ELSE {_repair("name")} END AS name FROM s WHERE rule_code IN ('B04', 'B06')),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, rule_code, name ORDER BY ord) AS nth FROM r WHERE name NOT IN ('', '总公司', '某某'))
SELECT doc_id, page, rule_code, name, greatest(said, 1)::BIGINT AS count FROM f WHERE nth = 1""")
def vision_rules(spark, sf_dir):
    return align.vision_rules(_said(spark, sf_dir)).select("doc_id", "page", "rule_code", "name", "count")


@query(f"""WITH t AS (SELECT c_custkey, '东海' || c_custkey % 7 || '有限公司' AS firm, c_custkey % 5 > 0 AS seen FROM customer),
r AS (SELECT c_custkey AS doc_id, 1 AS page, x.kind, CASE x.kind WHEN 'company' THEN firm ELSE '张伟' END AS name, CASE WHEN seen THEN CASE x.kind WHEN 'company' THEN 1 ELSE 2 END ELSE CASE x.kind WHEN 'company' THEN 1 ELSE greatest(c_custkey % 3, 1) END END AS count
  FROM t, (VALUES ('company'), ('person')) x(kind)
  UNION ALL SELECT c_custkey, 2, 'person', '李娜', 2 FROM t WHERE NOT seen)
SELECT doc_id, page, kind, name, count::BIGINT AS count FROM r""")
def refined_rules(spark, sf_dir):
    """What was said of pages with text is counted anew in it; what was said of others stays."""
    pages = co.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(_SEEN_TEXT).alias("text"))
    rules = align.refined_rules(_said(spark, sf_dir), pages)
    items = rules.select("doc_id", "page", F.explode("rule_list").alias("r")).select("doc_id", "page", "r.rule_code", F.explode("r.items").alias("i"))
    return items.select("doc_id", "page", F.when(F.col("rule_code") == "B04", "person").otherwise("company").alias("kind"), F.col("i.name").alias("name"), F.col("i.count").cast("long").alias("count"))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def uploaded_documents(spark, sf_dir):
    """Documents as parts of uploaded bodies, found again by ranges of 64 kB."""
    at = shared(spark, "uploads")
    parts = co.table(spark, sf_dir, "documents").select(F.format_string("%d.pdf", "doc_id").alias("filename"), F.col("text").alias("data"))
    found = uploads.read_uploads(uploads.write_bodies(parts, f"{at}/bodies", f"{at}/listing"), f"{at}/bodies", 1 << 16)
    doc = F.regexp_extract("filename", "^(.*)\\.pdf$", 1).cast("long")
    return found.select(doc.alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


# From text to F1: labelled contracts of two pages, whose names are known, through extraction, merge and scores.

_WHO = "substr('赵钱孙李周吴郑王冯陈', CAST(c_custkey % 10 + 1 AS INT), 1)"
_CITY = "'海光' || CAST(c_custkey % 7 AS STRING)"
#: Per shape of a contract, in both dialects: its pages, and its persons and companies.
_CONTRACTS = (
    ((f"'甲方：' || {_CITY} || '贸易有限公司' || chr(10) || '法定代表人：' || {_WHO} || '建明'", "'乙方：南山医疗器械股份有限公司，经办人：李晓东'"),
     (f"{_WHO} || '建明'", "'李晓东'"), (f"{_CITY} || '贸易有限公司'", "'南山医疗器械股份有限公司'")),
    ((f"'买受人：北方' || {_CITY} || '集团' || chr(10) || '联系人：' || {_WHO} || '文 电话'", "' '"), (f"{_WHO} || '文'",), (f"'北方' || {_CITY} || '集团'",)),
    ((f"'本合同由 ' || {_CITY} || '建设有限公' ", f"'司与' || '江南大学签订，签字：' || {_WHO} || '国强董事长'"), (f"{_WHO} || '国强'",), (f"{_CITY} || '建设有限公司'",)),
    (("'蓝港贸易有限公司 and Mary Jane sign'", f"'委托方：' || {_CITY} || '物流有限公司'"), ("'Mary Jane'",), ("'蓝港贸易有限公司'", f"{_CITY} || '物流有限公司'")),
    (("'本页无签字，见附件'", f"'收款人' || {_WHO} || '某某；开户行：中州银行支行'"), (), ()),
)


def _by_shape(of) -> str:
    return "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN {of(c)}" for k, c in enumerate(_CONTRACTS)) + " END"


def _contract_gold() -> str:
    rows = [f"SELECT c_custkey AS doc_id, '{kind}' AS kind, {name} AS name FROM customer WHERE c_custkey % 5 = {k}" for k, c in enumerate(_CONTRACTS) for kind, some in (("person", c[1]), ("company", c[2])) for name in some]
    return " UNION ALL ".join(rows)


_CONTRACT_PAGES = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, {n + 1} AS page, {_by_shape(lambda c, n=n: c[0][n])} AS text FROM customer" for n in range(2))  # noqa: B023


@query(f"""WITH np AS (SELECT doc_id, page::INTEGER AS page, text FROM ({_CONTRACT_PAGES})), {_ENTITIES},
go AS (SELECT DISTINCT * FROM ({_contract_gold()})), fo AS (SELECT DISTINCT doc_id, kind, name FROM hits),
b AS (SELECT coalesce(go.kind, fo.kind) AS kind, go.name AS gn, fo.name AS fn FROM go FULL JOIN fo ON go.doc_id = fo.doc_id AND go.kind = fo.kind AND go.name = fo.name),
c AS (SELECT kind, count(*) FILTER (gn IS NOT NULL AND fn IS NOT NULL) AS tp, count(*) FILTER (gn IS NULL) AS fp, count(*) FILTER (fn IS NULL) AS fn FROM b GROUP BY kind),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""")
def labelled_f1(spark, sf_dir):
    """Precision, recall and F1 of names found in the texts of labelled contracts, by kind."""
    c = co.table(spark, sf_dir, "customer")
    pages = [c.select(F.col("c_custkey").alias("doc_id"), F.lit(n + 1).alias("page"), F.expr(_by_shape(lambda x, n=n: x[0][n])).alias("text")) for n in range(2)]
    gold = [c.filter(f"c_custkey % 5 = {k}").select(F.col("c_custkey").alias("doc_id"), F.lit(kind).alias("kind"), F.expr(name).alias("name")) for k, x in enumerate(_CONTRACTS) for kind, some in (("person", x[1]), ("company", x[2])) for name in some]
    pages = pages[0].union(pages[1])
    raw = names.heuristic_names(pages).select("doc_id", "kind", "name", F.col("page").alias("ord"))
    return assemble.scores(reduce(DataFrame.union, gold), align.merge_entities(pages, raw), "kind")


#: What a model says of a contract: its names, but for the first person of every eleventh, and a company that isn't there in every seventh.
_SAID_NAMES = [
    *((k, "person", name, "c_custkey % 11 > 0" if n == 0 else "true") for k, c in enumerate(_CONTRACTS) for n, name in enumerate(c[1])),
    *((k, "company", name, "true") for k, c in enumerate(_CONTRACTS) for name in c[2]), *((k, "company", "'远方虚构有限公司'", "c_custkey % 7 = 0") for k in range(len(_CONTRACTS))),
]
_SAID_NAMES_SQL = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{kind}' AS kind, {name} AS name FROM customer WHERE c_custkey % 5 = {k} AND {when}" for k, kind, name, when in _SAID_NAMES)


@query(f"""WITH np AS (SELECT doc_id, page::INTEGER AS page, text FROM ({_CONTRACT_PAGES})), t AS (SELECT doc_id, page, text FROM np WHERE NOT {_blank("text")}), hn AS ({_SAID_NAMES_SQL}){_ENTITIES.removeprefix(_HEURISTICS)},
go AS (SELECT DISTINCT * FROM ({_contract_gold()})), fo AS (SELECT DISTINCT doc_id, kind, name FROM hits),
b AS (SELECT coalesce(go.kind, fo.kind) AS kind, go.name AS gn, fo.name AS fn FROM go FULL JOIN fo ON go.doc_id = fo.doc_id AND go.kind = fo.kind AND go.name = fo.name),
c AS (SELECT kind, count(*) FILTER (gn IS NOT NULL AND fn IS NOT NULL) AS tp, count(*) FILTER (gn IS NULL) AS fp, count(*) FILTER (fn IS NULL) AS fn FROM b GROUP BY kind),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""")
def reply_f1(spark, sf_dir):
    """The same for what model replies say, read from their JSON and held against the texts; every kind reaches 0.90."""
    c = co.table(spark, sf_dir, "customer")
    pages = [c.select(F.col("c_custkey").alias("doc_id"), F.lit(n + 1).alias("page"), F.expr(_by_shape(lambda x, n=n: x[0][n])).alias("text")) for n in range(2)]
    gold = [c.filter(f"c_custkey % 5 = {k}").select(F.col("c_custkey").alias("doc_id"), F.lit(kind).alias("kind"), F.expr(name).alias("name")) for k, x in enumerate(_CONTRACTS) for kind, some in (("person", x[1]), ("company", x[2])) for name in some]
    some = lambda kind: F.array_compact(F.array(*[F.expr(f"CASE WHEN c_custkey % 5 = {k} AND {when} THEN {name} END") for k, of, name, when in _SAID_NAMES if of == kind]))
    said = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("n"), some("company").alias("c"), some("person").alias("r"))).alias("p")))
    facts = replies.reply_facts(c.select(F.col("c_custkey").alias("doc_id"), said.alias("raw")))
    raw = facts.select("doc_id", "kind", "name", F.lit(0).alias("ord"))
    return assemble.scores(reduce(DataFrame.union, gold), align.merge_entities(pages[0].union(pages[1]), raw), "kind")
