"""The library's SQL says what its columns and operators say."""

from pyspark.sql import functions as F

from pagewright import sql
from pagewright.operators import groups, ranges

TEXTS = [None, "", " \n\t　", "Ｂｌｕｅ　Harbor Co., Ltd.", "星 河 有 限 公司", "it's a \\ back'slash \"quoted\"", "张 伟总经理", "先生张伟", "a\r\nb\fc\x85d", "Blue Inc.", "../etc", "a:b", "name", " x ", "某人", "总公司", "(x)", "force", "OFF"]


def test_functions_are_the_column_rules(spark):
    sql.register(spark)
    for name, (args, _, rule) in sql.RULES.items():
        rows = [(k + 1, t) for k, t in enumerate(TEXTS)] if args.startswith("page") else [(t, u) for t in TEXTS for u in ("星河", "x")] if ", " in args else [(t,) for t in TEXTS]
        df = spark.createDataFrame(rows, args)
        df.createOrReplaceTempView("given")
        got = spark.sql(f"SELECT {name}({', '.join(df.columns)}) AS v FROM given").collect()
        want = df.select(rule(*[F.col(c) for c in df.columns]).alias("v")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), name


def test_groups(spark):
    rows = [(d, p, ("word " * (p * (d or 5) % 9)) if p % 4 else [None, " \n"][p % 8 == 0]) for d in (1, 2, None) for p in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string").repartition(5)
    df.createOrReplaceTempView("given_pages")
    sql.register(spark)
    got = spark.sql("SELECT * FROM group_pages(TABLE(given_pages) PARTITION BY doc_id ORDER BY (page), 3, 60)").collect()
    want = groups.char_groups(df, 3, 60).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 30


def test_page_ranges(spark):
    specs = [None, "", "  ", "1", " 3 - 5 ,7", "5-3", "0", "1000001", "1,,2", "a", "1-2-3", "+1", "-1", "1-", "١", "12345678901234567890", "2,1", "\t4", "1 - 1000001", "3-\t4", "3 "]
    df = spark.createDataFrame(list(enumerate(specs)), "k int, spec string")
    df.createOrReplaceTempView("given_specs")
    sql.register(spark)
    got = {}
    for r in spark.sql("SELECT k, r.* FROM given_specs, LATERAL page_ranges(spec) r").collect():
        got.setdefault(r["k"], []).append((r["start"], r["stop"], r["error"]))
    for r in df.select("k", "spec", ranges.parse_spec(F.col("spec")).alias("p")).collect():
        want = [(None, None, r["p"]["error"])] if r["p"]["ranges"] is None else [(x["start"], x["stop"], None) for x in r["p"]["ranges"]]
        assert got[r["k"]] == want, r["spec"]


def test_views(spark):
    df = spark.createDataFrame([(1, 1, "a b"), (1, 2, None), (1, 3, "z")], "doc_id long, page int, text string")
    sql.page_views(df)
    assert [tuple(r) for r in spark.sql("SELECT page, blank, chars, nonspace FROM page_facts ORDER BY page").collect()] == [(1, False, 3, 2), (2, True, 0, 0), (3, False, 1, 1)]
    assert [r["head"] for r in spark.sql("SELECT head FROM page_heads ORDER BY page").collect()] == ["z", "z", None]
