import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagewright.functions import spans, text as tx

NAMES = [
    ("星 河 有限\n公司，", "星河有限公司"), ("（星河有限公司）", "星河有限公司"), ("ＡＢＣ　Ｌｔｄ．", "ABC Ltd."), ("Blue Harbor Co., Ltd..", "Blue Harbor Co., Ltd."), ("John  Smith .", "John Smith"),
    ("", ""), (None, ""), ("  ", ""), ("()", ""), ("欧阳•娜・娜", "欧阳·娜·娜"), ("第 3 页", "第3页"), ("x 中 y", "x 中 y"), ("Inc.", "Inc."), ("(a", "(a"),
]


def test_repair_both_ways(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "name string").withColumn("fixed", tx.repair(F.col("name")))
    assert [r["fixed"] for r in df.collect()] == [w for _, w in NAMES] == [spans.repair(n) for n, _ in NAMES]


def test_identity_and_titles(spark):
    rows = [("Acme Ltd.", "Acme Ltd", "Acme Ltd."), ("张伟先生", "张伟先生", "张伟"), ("经理李娜", "经理李娜", "李娜"), ("先生", "先生", "先生"), ("审判员王 强同志", "审判员王强同志", "王强")]
    df = spark.createDataFrame([(r[0],) for r in rows], "name string").select(tx.identity(F.col("name")).alias("i"), tx.repair_person(F.col("name")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]
    assert [spans.identity(r[0]) for r in rows] == [r[1] for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("中文河3 \n\t()（）【·•,.Ltdx　Ａ"), max_size=24))
def test_normal_form_keeps_places(text):
    norm, places = spans.normal_form(text)
    assert len(norm) == len(places) and places == sorted(places)
    assert all(n == " " or n == spans.fold(text[p]) for n, p in zip(norm, places))
    assert spans.repair(spans.repair(text)) == spans.repair(text) or "(" in text or "（" in text


@pytest.mark.parametrize("name, person, company", [
    ("张伟", True, False), ("张某", False, False), ("原告", False, False), ("欧阳娜娜", True, False), ("中", False, False), ("一二三四五六七", False, False), ("阿卜杜拉·买买提江", True, False), ("John Smith", True, False),
    ("星河有限公司", False, True), ("有限公司", True, False), ("某市人民法院", False, False), ("人民法院服务公司", False, True), ("中州大学", True, False), ("Acme Co", False, True), ("Acme Ltd.", False, True), ("12345", False, False),
])
def test_acceptable(spark, name, person, company):
    r = spark.createDataFrame([(name,)], "n string").select(tx.acceptable_person(F.col("n")).alias("p"), tx.acceptable_company(F.col("n")).alias("c")).first()
    assert (r["p"], r["c"]) == (person, company)


def test_find_and_cover():
    page = spans.Page("星河有 限公司与星河有限公司分公司。星河", "有限公司在下页")
    assert [h.source_start for h in page.find("星河有限公司")] == [0, 8, 18]
    assert [h.source_start for h in page.uncovered("星河有限公司", ["星河有限公司分公司"], False)] == [0, 18]
    assert spans.Page("a", "星河有限公司").find("星河有限公司") == []
    loose = spans.Page("星河技术有限公同。")
    assert loose.find("星河技术有限公司") == [] and len(loose.find_alike("星河技术有限公司")) == 1
    assert spans.Page("Acme Ltd. x").find("Acme Ltd")[0].source_stop == 9
    assert spans.prefer_corrected("与星河技术有限公同签", "星河技术有限公司") == "与星河技术有限公司签"


def test_excerpts_hold_the_name_and_have_a_length():
    source = "前" * 300 + "星河 有限公司" + "后" * 300
    said = spans.excerpt(source, 300, 307)
    assert "星河有限公司" in said and len(said) == 100
    assert spans.excerpt("星河有限公司", 0, 6) == "星河有限公司" and spans.excerpt("x", 3, 2) == ""


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\fc\r d　", "x"), (" \t　\n", None)], "t string, u string")
    r = df.select(tx.line_breaks(F.col("t")).alias("l"), tx.nonspace_count(F.col("t")).alias("n"), tx.blank(F.col("t")).alias("b"), tx.blank(F.col("u")).alias("bu")).collect()
    assert [tuple(x) for x in r] == [("a\nb\nc\n d", 4, False, False), ("", 0, True, True)]
    raw = 'x ```json\n{"a": "//no, ]", /* c */ "b": [1, 2,], } // end\n```'
    j = spark.createDataFrame([(raw,), ("none",)], "r string").select(tx.strict_json(tx.json_object(F.col("r"))).alias("j")).collect()
    import json

    assert json.loads(j[0]["j"]) == {"a": "//no, ]", "b": [1, 2]} and j[1]["j"] is None
