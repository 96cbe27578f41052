"""Names against pages: containment, coverage, suppression, and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import spans
from ..functions.text import LEGAL_FORMS, acceptable_company, acceptable_person, blank, identity, is_branch, joined_space, repair, repair_person
from ..shared import written
from .assemble import RULES, page_rules, sanitized
from .groups import lookahead

HIT = "array<struct<start:int,stop:int,source_start:int,source_stop:int>>"


def containment(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, page, name, count): exact occurrences, one after the other, of each name in its document's pages. Catalyst only.

    An equi join on doc_id; the containment test is its residual condition.
    """
    p = pages.filter(~blank(F.col("text"))).select("doc_id", "page", joined_space(F.col("text")).alias("norm"))
    n = names.select(F.col("doc_id").alias("of"), repair(F.col("name")).alias("name")).filter("name != ''").distinct()
    hits = p.join(n, (F.col("doc_id") == F.col("of")) & F.col("norm").contains(F.col("name")))
    count = (F.length("norm") - F.length(F.replace("norm", F.col("name"), F.lit("")))) / F.length("name")
    return hits.select("doc_id", "page", "name", count.cast("long").alias("count"))


def uncovered_hits(hits: DataFrame) -> DataFrame:
    """hits (doc_id, page, name, start, stop) that no hit of a longer name containing theirs encloses strictly."""
    o = hits.select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "page", "name", "start", "stop")])
    over = (
        (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page"))
        & (F.col("o_start") <= F.col("start")) & (F.col("o_stop") >= F.col("stop")) & (F.col("o_stop") - F.col("o_start") > F.col("stop") - F.col("start"))
        & F.col("o_name").contains(F.col("name"))
    )
    return hits.join(o, over, "left_anti")


def find_positions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, page, name, start, stop) of exact hits, by splitting at the name. Catalyst only."""
    p = pages.filter(~blank(F.col("text"))).select("doc_id", "page", joined_space(F.col("text")).alias("norm"))
    n = names.select(F.col("doc_id").alias("of"), repair(F.col("name")).alias("name")).filter("name != ''").distinct()
    hits = p.join(n, (F.col("doc_id") == F.col("of")) & F.col("norm").contains(F.col("name")))
    lengths = F.transform(F.split(F.col("norm"), F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")), -1), F.length)
    out = hits.select("doc_id", "page", "name", F.posexplode(lengths).alias("nth", "gap"), F.size(lengths).alias("pieces"))
    # a running sum over a name's hits on a page, so that many hits cost their number
    before = F.sum("gap").over(W.partitionBy("doc_id", "page", "name").orderBy("nth")) + F.col("nth") * F.length("name")
    out = out.withColumn("start", before.cast("int")).filter(F.col("nth") < F.col("pieces") - 1).select("doc_id", "page", "name", "start")
    return out.withColumn("stop", F.col("start") + F.length("name"))


def suppress_contained(companies: DataFrame) -> DataFrame:
    """companies (doc_id, name) of which no longer one of the document contains the name."""
    o = companies.select(F.col("doc_id").alias("of"), F.col("name").alias("longer")).distinct()
    over = (F.col("doc_id") == F.col("of")) & (F.length("longer") > F.length("name")) & F.col("longer").contains(F.col("name"))
    return companies.join(o, over, "left_anti")


def suppress_short(companies: DataFrame) -> DataFrame:
    """As suppress_contained(), but a name stays beside its own branches.

    Whether a longer name is itself suppressed matters only through the branch rule, so names are decided
    longest first; a document's names are a bounded set next to its pages and are folded in an array.
    """
    ordered = F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), F.col("name").alias("name"))))
    keep = F.aggregate(
        F.transform("all", lambda x: x["name"]),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: (F.length(k) > F.length(x)) & k.contains(x) & ~is_branch(k, x)), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return companies.groupBy("doc_id").agg(ordered.alias("all")).select("doc_id", F.explode(keep).alias("name"))


def expand_legal_form(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, full): the longest form of a company's name that a page continues with a legal form."""
    p = pages.filter(~blank(F.col("text"))).select("doc_id", joined_space(F.col("text")).alias("norm"))
    n = names.select(F.col("doc_id").alias("of"), "name").distinct()
    open_ = ~F.col("name").rlike("(?:公司|事务所|合伙企业|合作社)$")
    hits = n.join(p, (F.col("doc_id") == F.col("of")) & open_ & F.col("norm").contains(F.col("name")), "left")
    pattern = F.concat(F.lit(r"(?<![一-鿿㐀-䶿·\p{Nd}])(\Q"), F.col("name"), F.lit(r"\E(?:"), F.lit("|".join(LEGAL_FORMS)), F.lit("))"))
    longest = F.array_max(F.transform(F.regexp_extract_all(F.col("norm"), pattern, F.lit(1)), lambda x: F.struct(F.length(x).alias("n"), x.alias("name"))))
    best = hits.withColumn("best", F.when(F.col("norm").isNotNull(), longest))
    return best.groupBy("of", "name").agg(F.max("best").alias("best")).select(F.col("of").alias("doc_id"), "name", F.coalesce("best.name", "name").alias("full"))


def acceptable_names(raw: DataFrame) -> DataFrame:
    """raw (doc_id, kind, name, ord) repaired, filtered by kind, the first of each identity kept."""
    name = F.when(F.col("kind") == "person", repair_person(F.col("name"))).otherwise(repair(F.col("name")))
    good = lambda n: F.when(F.col("kind") == "person", acceptable_person(n)).otherwise(acceptable_company(n))
    one = F.filter(F.array(name), lambda n: (n != "") & good(n))  # so that the repaired name is computed once, not in each test
    some = raw.withColumn("name", F.explode(one))
    first = W.partitionBy("doc_id", "kind", identity(F.col("name"))).orderBy("ord")
    return some.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def located(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, page, kind, name, exact, nth, start, stop, said): every hit of names (doc_id, kind, name) on pages, with its snippet.

    Companies may be one lookalike off where a page has them not exactly; exact says so. start and stop are places
    of the page's normal form. A page's text and the names of its document meet in one row; the walk over
    positions is an Arrow batch function, because snippets need places in the unfolded source.
    """
    kind = dict(pages.dtypes)["doc_id"]
    p = lookahead(pages.select("doc_id", F.col("page").cast("int").alias("page"), "text")).filter(~blank(F.col("text")))
    by_kind = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k)
    n = names.groupBy(F.col("doc_id").alias("of")).agg(by_kind("company"), by_kind("person"))
    rows = p.join(n, F.col("doc_id") == F.col("of")).select("doc_id", "page", "text", "head", "company", "person")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, out = [], [[] for _ in range(7)]
            for k, (text, head, companies, persons) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)))):
                page = spans.Page(text, head)
                for what, own in (("company", companies), ("person", persons)):
                    for name in own:
                        hits = page.find_alike(name) if what == "company" else page.find(name)
                        form = spans.name_form(name)
                        for nth, h in enumerate(hits):
                            at.append(k)
                            said = spans.prefer_corrected(spans.excerpt(page.source, h.source_start, h.source_stop), name)
                            for c, v in zip(out, (what, name, page.norm.startswith(form, h.start), nth, h.start, h.stop, said)):
                                c.append(v)
            i = pa.array(at, pa.int64())
            kinds = pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()
            cols = [b.column(0).take(i), b.column(1).take(i), *(pa.array(c, t) for c, t in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "page", "kind", "name", "exact", "nth", "start", "stop", "said"])

    return rows.mapInArrow(run, f"doc_id {kind}, page int, kind string, name string, exact boolean, nth int, start int, stop int, said string")


def _uncovered(hits: DataFrame) -> DataFrame:
    """located() hits that no exact hit of a longer name, whose identity has theirs in it, encloses. Persons don't cover companies."""
    h = hits.withColumn("own", identity(F.col("name")))
    o = h.filter("exact").select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "page", "kind", "name", "own", "start", "stop")])
    over = (
        F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("page") == F.col("o_page"))
        & (F.col("o_start") <= F.col("start")) & (F.col("o_stop") >= F.col("stop")) & (F.col("o_stop") - F.col("o_start") > F.col("stop") - F.col("start"))
        & (F.length("o_name") > F.length("name")) & F.col("o_own").contains(F.col("own")) & ((F.col("kind") == "person") | (F.col("o_kind") == "company"))
    )
    return h.join(o, over, "left_anti").drop("own")


def _told(hits: DataFrame) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("nth", "said")))
    return hits.groupBy("doc_id", "kind", "name", "page").agg(F.count("*").alias("count"), said.alias("said")).select("doc_id", "page", "kind", "name", "count", F.transform("said", lambda x: x["said"]).alias("origin_text"))


def name_hits(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, name, page, count, origin_text) of names (doc_id, kind, name) with hits that nothing longer covers.

    Companies may be one lookalike off; persons are covered by companies and longer persons, companies by companies.
    """
    return _told(_uncovered(written(located(pages, names), "located")))


def merge_entities(pages: DataFrame, raw: DataFrame) -> DataFrame:
    """name_hits() of raw names (doc_id, kind, name, ord) after filtering, legal forms, alignment and suppression.

    Names are filtered once and pages walked once: what suppression leaves is taken from the hits found then.
    """
    good = written(acceptable_names(raw), "names")
    full = expand_legal_form(pages, good.filter("kind = 'company'")).select("doc_id", F.lit("company").alias("kind"), F.col("full").alias("name")).distinct()
    hits = written(located(pages, full.unionByName(good.filter("kind = 'person'").select("doc_id", "kind", "name"))), "located")
    aligned = _uncovered(hits.filter("kind = 'company'")).select("doc_id", "name").distinct()
    companies = suppress_short(aligned).select(F.col("doc_id").alias("of"), F.col("name").alias("stays"))
    stay = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("name") == F.col("stays"))
    left = hits.filter("kind = 'company'").join(companies, stay, "left_semi").union(hits.filter("kind = 'person'"))
    return _told(_uncovered(left))


def vision_rules(said: DataFrame) -> DataFrame:
    """sanitized() rules (doc_id, page, rule_code, ord, name, count, origin_text) whose names can be a person's or a company's."""
    kind = F.when(F.col("rule_code") == RULES["person"], "person").otherwise("company")
    name = F.when(F.col("kind") == "person", repair_person(F.col("said"))).otherwise(F.col("said"))
    good = lambda n: F.when(F.col("kind") == "person", acceptable_person(n)).otherwise(acceptable_company(n))
    # arrays of one, so that each step is computed once and not in every test that follows
    one = F.explode(F.array(F.col("name"))).alias("said")
    r = sanitized(said).withColumn("kind", kind)
    r = r.select(*[c for c in r.columns if c != "name"], one)
    return r.select(*[c for c in r.columns if c != "said"], F.explode(F.filter(F.array(name), lambda n: (n != "") & good(n))).alias("name"))


def refined_rules(said: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, rule_list): rules of vision_rules() checked against page texts.

    A document with text has its names aligned anew, with counts and snippets of the text; one without keeps
    what was said of it.
    """
    rules = vision_rules(said)
    has = pages.filter(~blank(F.col("text"))).select("doc_id").distinct()
    raw = rules.join(has, "doc_id", "left_semi").select("doc_id", "kind", "name", "ord")
    found = page_rules(merge_entities(pages, raw).select("doc_id", "page", "kind", "name", "count", "origin_text"))
    kept = page_rules(rules.join(has, "doc_id", "left_anti").select("doc_id", "page", "kind", "name", "count", "origin_text"))
    return found.unionByName(kept)
