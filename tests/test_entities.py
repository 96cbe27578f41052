"""Merged entities against plain loops over pages: hits, coverage, suppression, lookalikes and snippets."""

from pyspark.sql import functions as F

from pagewright.functions import spans, text as tx
from pagewright.operators import align, names
from pagewright.plans import corpus as co


def brute(pages, good, full):
    """(doc, page, kind, name, count, snippets), name by name and page by page."""
    out = []
    for doc in {p[0] for p in pages}:
        mine = sorted((p, t) for d, p, t in pages if d == doc and (t or "").strip())
        walk = [(p, spans.Page(t, mine[k + 1][1][: tx.HEAD_CHARS] if k + 1 < len(mine) else None)) for k, (p, t) in enumerate(mine)]
        companies = sorted({n for d, n in full if d == doc})
        persons = sorted({n for d, k, n in good if d == doc and k == "person"})
        seen = [n for n in companies if any(page.uncovered(n, companies, True) for _, page in walk)]
        stay = []
        for n in sorted(seen, key=lambda x: (-len(x), x)):
            branch = lambda k: k.startswith(n) and any(b in k[len(n) :] for b in tx.BRANCHES)  # noqa: E731, B023
            if not any(len(k) > len(n) and n in k and not branch(k) for k in stay):
                stay.append(n)
        for p, page in walk:
            for kind, own, covers in (("company", stay, stay), ("person", persons, stay + persons)):
                for n in own:
                    hits = page.uncovered(n, covers, kind == "company")
                    if hits:
                        out.append((doc, p, kind, n, len(hits), [spans.prefer_corrected(spans.excerpt(page.source, h.source_start, h.source_stop), n) for h in hits]))
    return out


def merged(spark, pages, raw):
    df = spark.createDataFrame(pages, "doc_id long, page int, text string")
    good = align.acceptable_names(raw)
    full = align.expand_legal_form(df, good.filter("kind = 'company'"))
    want = brute(pages, [tuple(r) for r in good.select("doc_id", "kind", "name").collect()], [(r["doc_id"], r["full"]) for r in full.collect()])
    got = align.merge_entities(df, raw).select("doc_id", "page", "kind", "name", "count", "origin_text").collect()
    return sorted(map(str, ((*r[:5], list(r[5])) for r in got))), sorted(map(str, want)), got


def test_all_pages_of_the_corpus(spark):
    pages = [tuple(r) for r in co.name_pages(spark, "/root/testdata/sf0.001").select("doc_id", "page", "text").collect()]
    raw = names.heuristic_names(spark.createDataFrame(pages, "doc_id long, page int, text string")).select("doc_id", "kind", "name", F.col("page").alias("ord"))
    got, want, _ = merged(spark, pages, raw)
    assert got == want and len(got) > 100


def test_lookalikes_covers_and_branches(spark):
    pages = [
        (1, 1, "甲方：海光技术有限公司。海光技木有限公司 又 海光技术有限公司分公司"), (1, 2, "只有海光技木有限公司和海光技木有限可司。" * 3), (1, 3, " \n"), (1, 4, "李娜代表海光技术有限公司签字，李娜娜不在。海光技术有"), (1, 5, "限公司"),
        (2, 1, "（ＡＢＣ）星 河 股份有限公司，Blue Harbor Trading Co., Ltd. and Blue Harbor Trading Co., Ltd"), (2, 2, None), (2, 3, "星河股分有限公司" + "长" * 200 + "星河股份有限公司"),
    ]
    raw = [(1, "company", "海光技术有限公司"), (1, "company", "海光技术有限公司分公司"), (1, "person", "李娜"), (1, "person", "李娜娜"), (1, "company", "海光技术"), (2, "company", "星河股份有限公司"), (2, "company", "Blue Harbor Trading Co., Ltd.")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(raw)], "doc_id long, kind string, name string, ord int")
    got, want, rows = merged(spark, pages, df)
    assert got == want
    count = {(r["page"], r["name"]): r["count"] for r in rows if r["doc_id"] == 1}
    assert count[2, "海光技术有限公司"] == 3  # one lookalike counts, two don't
    assert all("海光技术" in s for r in rows if r["page"] == 2 and r["doc_id"] == 1 for s in r["origin_text"])


def test_replies_reach_the_gate(spark):
    from pagewright.plans import catalog

    for r in catalog.reply_f1(spark, "/root/testdata/sf0.001").collect():
        assert r["f1"] >= 0.9, r
