from pyspark.sql import functions as F

from pagewright.operators import align, assemble, classify, groups, names, ranges, replies, schedule
from pagewright.sources import files


def test_page_specs(spark):
    specs = {"1,3,5-8": ("1,3,5-8", None), " 2 - 4 ": ("2-4", None), "": (None, "empty selection"), "1,,2": (None, "empty entry"), "+1": (None, "not a page or a range"), "5-3": (None, "range runs backwards"),
             "0": (None, "page below 1"), "1000001": (None, "page too large"), "1-2-3": (None, "not a page or a range"), "a": (None, "not a page or a range"), None: (None, None)}
    df = spark.createDataFrame([(s,) for s in specs], "s string").withColumn("p", ranges.parse_spec(F.col("s")))
    assert {r["s"]: (r["c"], r["e"]) for r in df.select("s", ranges.format_ranges(F.col("p.ranges")).alias("c"), F.col("p.error").alias("e")).collect()} == specs


def test_grouping_cases(spark):
    def made(pages, n, most):
        rows = groups.char_groups(spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(pages)], "doc_id long, page int, text string"), n, most).collect()
        return [(r["pages"], len(r["text"])) for r in sorted(rows, key=lambda r: r["group_no"])]

    assert [len(p) for p, _ in made(["x"] * 25, 10, 10_000)] == [10, 10, 5]
    assert [p for p, _ in made([" " if k % 3 == 2 else "y" for k in range(9)], 4, 10_000)] == [[1, 2, 4, 5], [7, 8]]
    assert [p for p, _ in made(["a" * 80, "b" * 80], 10, 120)] == [[1], [2]]
    assert made(["a" * 200, "b"], 10, 40) == [([1], 40), ([2], 17)]
    assert made([" ", ""], 3, 50) == []


def test_layer_reasons(spark):
    rows = [("off", "x" * 50, 50, 0, 3, False, 0.0, "off"), (None, " ", 1, 0, 3, False, 0.0, "no-text"), (None, "x" * 50, 50, 0, 0, False, 0.0, "no-text"), ("FORCE", "x", 1, 1, 1, False, 0.0, "force"),
            (None, "x" * 50, 50, 2, 1, False, 0.0, "unknown-chars"), (None, "x" * 50, 50, 1, 1, False, 0.6, "image-little-text"), (None, "x" * 39, 39, 0, 1, False, 0.5, "short-text"),
            (None, "x" * 250, 250, 0, 1, True, 0.9, "invisible-layer"), ("auto", "x" * 40, 40, 0, 1, False, 0.54, "text")]
    df = spark.createDataFrame(rows, "mode string, text string, char_count long, unknown_count long, text_objects long, invisible boolean, image_coverage double, want string")
    assert all(r["reason"] == r["want"] for r in classify.classify_layer(df).collect())


def test_heuristics():
    rules = names.Heuristics()
    found = list(rules.events("买方为李宁体育用品有限公司，联系人：陈晓东 电话。张伟先生与欧阳娜娜签字\n王强有限公司"))
    assert ("company", "李宁体育用品有限公司") in found and ("person", "陈晓东") in found and ("person", "张伟") in found
    assert not any(n in ("李宁", "王强") for _, n in found)
    assert rules.company("（星河集团") == "星河集团" and rules.person("经理") is None


def test_rare_surnames(spark):
    singles, compounds = "卫储俞凌褚尤戚柏酆逄蒯佴桓公", ["司空", "端木", "澹台", "即墨", "万俟", "赫连", "南荣"]
    people = [c + "建明" for c in singles if c != "佴"] + [c + "文" for c in compounds]
    for form in ("联系人：{} ", "{}先生", "{}\n"):
        rows = [(k, 1, form.format(n)) for k, n in enumerate([*people, "佴建明", "晴建明"])]  # the last two have no listed surname
        found = names.heuristic_names(spark.createDataFrame(rows, "doc_id long, page int, text string")).filter("kind = 'person'")
        assert {(r["doc_id"], r["name"]) for r in found.collect()} == set(enumerate(people))
    assert len(names.SURNAMES) == 408 and len(names.COMPOUND_SURNAMES) == 69


def test_names_merge_and_drop_covered(spark):
    pages = spark.createDataFrame([(1, 1, "甲方：星河技术有 限公同 负责人：李 娜。李娜签字"), (1, 2, "  "), (1, 3, "海光股份有限公司及其海光股份有限公司分公司")], "doc_id long, page int, text string")
    raw = [("company", "星河技术有限公司"), ("company", "海光"), ("company", "海光集团"), ("company", "海光股份有限公司"), ("company", "海光股份有限公司分公司"), ("person", "李 娜"), ("person", "原告"), ("person", "赵六")]
    found = align.merge_entities(pages, spark.createDataFrame([(1, k, n, i) for i, (k, n) in enumerate(raw)], "doc_id long, kind string, name string, ord long"))
    got = {(r["kind"], r["name"]): (r["page"], r["count"]) for r in found.collect()}
    assert got == {("company", "星河技术有限公司"): (1, 1), ("company", "海光股份有限公司"): (3, 1), ("company", "海光股份有限公司分公司"): (3, 1), ("person", "李娜"): (1, 2)}
    assert all("星河技术有限公司" in r["origin_text"][0] for r in found.filter("name = '星河技术有限公司'").collect())
    full = align.expand_legal_form(pages, spark.createDataFrame([(1, "海光"), (1, "光"), (1, "海光公司")], "doc_id long, name string"))
    assert {r["name"]: r["full"] for r in full.collect()} == {"海光": "海光股份有限公司", "光": "光", "海光公司": "海光公司"}


def test_short_names_and_branches(spark):
    df = spark.createDataFrame([(1, n) for n in ("海光有限公司", "海光有限公司分公司", "大海光有限公司", "光有限公司")], "doc_id long, name string")
    assert {r["name"] for r in align.suppress_short(df).collect()} == {"海光有限公司分公司", "大海光有限公司"}
    assert {r["name"] for r in align.suppress_contained(df).collect()} == {"海光有限公司分公司", "大海光有限公司"}
    only = df.filter("name LIKE '海光%'")
    assert {r["name"] for r in align.suppress_short(only).collect()} == {"海光有限公司", "海光有限公司分公司"}


def test_replies(spark):
    rows = [(1, '```json\n{"p":[{"n":"2","c":["A",["B",0],{"n":"C","c":"3"},[],5],"r":null},{"n":0,"c":["Z"]},]}\n```'), (2, "broken {"), (3, '{"companies":["A"]}'), (4, None)]
    got = {(r["doc_id"], r["page"], r["name"], r["count"]) for r in replies.reply_facts(spark.createDataFrame(rows, "doc_id long, raw string")).collect()}
    assert got >= {(1, 2, "A", 1), (1, 2, "B", 1), (1, 2, "C", 3), (3, None, "A", 1)} and not any(n == "Z" or d in (2, 4) for d, _, n, _ in got)


def test_hash_does_not_depend_on_row_order(spark):
    rows = [(1, k, f"t{k}" if k % 3 else None) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    assert assemble.text_hash(df.repartition(7)).first() == assemble.text_hash(df.coalesce(1)).first()


def test_liveness_and_leases(spark):
    probes = spark.createDataFrame([("a", 1, 1, "ok"), ("a", 2, 2, "fail"), ("a", 3, 3, "fail"), ("a", 4, 4, "ok")], "node string, s long, seq long, kind string").selectExpr("*", "timestamp_seconds(s) AS ts", "true AS up")
    assert [r["healthy"] for r in schedule.liveness(probes).orderBy("ts").collect()] == [True, True, False, True]
    lease = spark.range(1).select(*[schedule.lease_ms(F.lit(n), F.lit(100), F.lit(250), F.lit(900)).alias(str(n)) for n in (1, 5, 50)]).first()
    assert tuple(lease) == (250, 500, 900)
    assert [r[0] for r in spark.range(1, 8).select(schedule.backoff_ms(F.col("id").cast("int"))).collect()] == [200, 400, 800, 1600, 2000, 2000, 2000]


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"no"), ("c.pdf", b""), ("d.pdf", b"%PDF" + b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["error"], r["content"] is not None) for r in files.scan_documents(spark, str(tmp_path), most=50).collect()}
    assert got == {"a.pdf": (None, True), "b.pdf": ("not a PDF", False), "d.pdf": ("too large", False)}
    pages = spark.createDataFrame([(1, 1, "tab\there\nnow"), (1, 2, None)], "doc_id long, page int, text string")
    files.write_trace(pages, f"{tmp_path}/trace", 3)
    lines = {r["page"]: r for r in spark.read.json(f"{tmp_path}/trace").collect()}
    assert lines[1]["text"] == "tab" and lines[1]["chars"] == 12 and lines[1]["truncated"]
    files.write_report(pages, f"{tmp_path}/report")
    assert spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/report").filter("text = 'tab here now'").count() == 1
    shared = spark.createDataFrame([("j1.pdf", 5), ("j2.pdf", 5), ("j3.pdf.partial", 9)], "name string, length long")
    jobs = spark.createDataFrame([("j1", 5), ("j2", 6), ("j3", 9)], "job_id string, length long")
    assert [r["job_id"] for r in files.adopted(shared, jobs).collect()] == ["j1"]


def test_outside_engine_sees_only_pages_without_a_layer(spark):
    import pyarrow as pa

    def engine(batches):
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" read\r\n"] * n), pa.array([1.0] * n)], names=["doc_id", "page", "text", "ocr_ms"])

    pages = spark.createDataFrame([(1, 1, True), (1, 2, False)], "doc_id long, page int, use_layer boolean")
    assert [(r["page"], r["text"].strip()) for r in files.recognise(pages, engine).collect()] == [(2, "read")]
    assert [r["text"] for r in files.recognise(pages, engine, most=3).collect()] == ["rea"]


def test_selections(spark):
    df = spark.createDataFrame([(1, [3, 1, 3], "1-2", "5"), (2, [], None, "5"), (3, None, "", None)], "id long, pages array<int>, body string, query string")
    rows = {r["id"]: r for r in df.select("id", ranges.single_pages(F.col("pages")).alias("r"), ranges.prefer_body(F.col("body"), F.col("query")).alias("s")).collect()}
    assert [tuple(x) for x in rows[1]["r"]] == [(3, 3), (1, 1), (3, 3)] and rows[2]["r"] == [] and rows[3]["r"] is None
    assert [rows[k]["s"] for k in (1, 2, 3)] == ["1-2", "5", ""]


def test_callbacks(spark, tmp_path):
    df = spark.createDataFrame([("j1", [1, 2], None), ("j2", [], "failed")], "job_id string, pages array<int>, error string")
    files.write_callbacks(df, f"{tmp_path}/out")
    files.write_callbacks(df.limit(1), f"{tmp_path}/out")  # later ones are added
    got = sorted(((r["job_id"], r["pages"], r["error"]) for r in spark.read.schema(df.schema).json(f"{tmp_path}/out").collect()), key=str)
    assert got == [("j1", [1, 2], None), ("j1", [1, 2], None), ("j2", [], "failed")]


def test_vision_rules(spark):
    said = [
        (1, 1, "b04", 1, "张伟 先生", 0, ["张伟先生签字"]), (1, 1, "B04", 2, "原告", 1, []), (1, 1, "B06", 3, "星河技术有限公司", 2, ["a" * 150]), (1, 1, "B06", 4, "星河技术 有限公司", 1, []), (1, 2, "X1", 5, "海光集团", 1, []),
        (2, 1, "B06", 6, "海光集团", 3, ["海光集团"]), (2, 1, "B06", 7, "某市人民法院", 1, []), (1, 1, "B06", 8, "不在文中有限公司", 1, []),
    ]
    rules = spark.createDataFrame(said, "doc_id long, page int, rule_code string, ord long, name string, count int, origin_text array<string>")
    got = {(r["doc_id"], r["page"], r["kind"], r["name"], r["count"]) for r in align.vision_rules(rules).collect()}
    assert got == {(1, 1, "person", "张伟", 1), (1, 1, "company", "星河技术有限公司", 2), (2, 1, "company", "海光集团", 3), (1, 1, "company", "不在文中有限公司", 1)}
    pages = spark.createDataFrame([(1, 1, "甲方：星河技术有限公司，张 伟、张伟先生"), (1, 2, " "), (2, 1, None)], "doc_id long, page int, text string")
    found = {(r["doc_id"], r["page"], r["kind"], r["name"], r["count"]) for r in assemble.flat_hits(align.refined_rules(rules, pages)).collect()}
    assert found == {(1, 1, "person", "张伟", 2), (1, 1, "company", "星河技术有限公司", 1), (2, 1, "company", "海光集团", 3)}


def test_many_hits_on_a_page(spark):
    """20,000 of them: their places come from one running sum."""
    text = "海光公司，" * 20_000
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    hits = align.find_positions(df, spark.createDataFrame([(1, "海光公司"), (1, "没有公司")], "doc_id long, name string"))
    assert sorted(tuple(r) for r in hits.select("name", "start", "stop").collect()) == [("海光公司", 5 * k, 5 * k + 4) for k in range(20_000)]


def test_slices_do_not_matter(spark):
    """Events of one key in slices of a second and of a year give the same."""
    import random

    rng = random.Random(4)
    rows = [(k, rng.randint(0, 400), rng.choice(["claim", "fail", "expire", "commit"]), rng.choice("ab"), rng.choice("xy")) for k in range(600)]
    e = spark.createDataFrame(rows, "seq long, s long, kind string, node string, group_id string").selectExpr("*", "timestamp_seconds(s) AS ts", "node AS job", "300 AS total")
    probes = e.selectExpr("node", "ts", "seq", "CASE WHEN kind IN ('fail', 'expire') THEN 'fail' ELSE 'ok' END AS kind", "true AS up")
    for make in (lambda w: schedule.attempts(e, slice_s=w), lambda w: schedule.same_failer(e, slice_s=w), lambda w: schedule.progress_lines(e, slice_s=w), lambda w: schedule.liveness(probes, slice_s=w)):
        one, many = (sorted(map(str, make(w).collect())) for w in (31_536_000, 1))
        assert one == many and one
