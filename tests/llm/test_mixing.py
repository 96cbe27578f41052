import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from pagewright.llm import mixing

ROWS = [(i, "word " * (i % 7 + 1) + "\x0btail one", ["a", "b", None, "B"][i % 4 if i % 3 else 0], "en") for i in range(600)]
ROWS += [(9000, "x " * 5000, "rare", "en"), (9001, None, "nul", None), (9002, "", "rare", "en"), (5, "again and again", "a", "en"), (5, "again and again", "a", "en"), (None, "a b", "a", "en")]


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3))


def test_matches_sorted_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(mixing.OP3_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in mixed(spark, ROWS).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))


def test_sources_come_near_their_targets(spark):
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in mixed(spark, ROWS).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    sizes = defaultdict(int)
    for r in mixed(spark, ROWS).collect():
        sizes[r["source"]] += r["size"]
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(target[s] <= 3 * sizes[s] for s in target)


def test_long_documents_at_the_threshold_leave_no_gap(spark, tmp_path):
    """Sources of small and very long documents come within 2 % where later ones can fill up; SQL takes the same ones."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([3, 10, 40, 200, 3000 if i % 3 else 60]), f"s{i % 8}", "en") for i in range(1600)]
    con, taken, target = duckdb.connect(), defaultdict(int), {}
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[4] for r in con.execute(mixing.OP3_SQL).fetchall()}
    for r in mixed(spark, rows).collect():
        assert r["taken"] == want[r["doc_id"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert mixing.mixed_documents(docs).agg(F.sum(F.floor(F.length("text") / 2))).first()[0] == sum(want.values())


def test_hot_source_and_levels(spark):
    rows = [(i, "a b c", "hot" if i % 10 else f"s{i % 7}", "") for i in range(9000)]
    taken = defaultdict(int)
    for r in mixed(spark, rows).collect():
        taken[r["source"]] += r["taken"]
        target = r["target"]
        if r["source"] == "hot":
            hot = target
    assert abs(taken["hot"] - hot) <= 3


def test_no_rows_and_only_empty_texts(spark):
    assert mixed(spark, []).count() == 0
    assert [r["taken"] for r in mixed(spark, [(1, None, None, None), (2, "", "a", "")]).collect()] == [0, 0]


def test_clashing_columns_come_back_as_they_are(spark):
    names = ["h", "of", "full", "edge", "at_edge", "row", "col", "copies", "size"]
    rows = [(i, "a b c d", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mixed_documents(df).collect()
    assert len(out) == 60 and all(tuple(r) == rows[r["doc_id"]] for r in out)
