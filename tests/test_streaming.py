from pagewright.streaming import pages as ps


def run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_pages_out_of_order(spark, tmp_path):
    arrivals = [(1, 2, "two"), (1, 1, "one"), (1, 3, " "), (1, 5, "five"), (1, 4, "four"), (1, 2, "again"), (1, 7, None), (2, 1, "solo")]
    for k, row in enumerate(arrivals):  # one file, one batch each
        spark.createDataFrame([row], "doc_id long, page int, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    stream = spark.readStream.schema("doc_id long, page int, text string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    rows = run(spark, ps.ordered_groups(stream, 2, 1000), "ordered")
    good = sorted((r["group_no"], r["pages"], r["head"]) for r in rows if r["error"] is None)
    assert [(g, p) for g, p, _ in good] == [(0, [1, 2]), (1, [4, 5])]
    assert good[0][2] == "four" and good[1][2] is None
    assert [(r["pages"], r["error"]) for r in rows if r["error"]] == [([2], "page came twice")]
    spark.conf.unset("spark.sql.streaming.checkpointLocation")


def test_first_commit_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k}:00", 1, k % 2, "commit", f"n{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "t string, job long, page long, kind string, node string").selectExpr("timestamp(t) AS ts", "job", "page", "kind", "node")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    assert {(r["page"], r["node"]) for r in run(spark, ps.first_commits(stream), "firsts")} == {(0, "n0"), (1, "n1")}
    spark.conf.unset("spark.sql.streaming.checkpointLocation")


def test_rates_stream(spark, tmp_path):
    """A window is told once the watermark has passed its end."""
    minutes = [0, 0, 0, 1, 1, 30]
    rows = [(f"2024-01-01 00:{m:02d}:{k:02d}", "commit" if k != 1 else "claim", "n") for k, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "t string, kind string, node string").selectExpr("timestamp(t) AS ts", "kind", "node")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    found = {(r["start"].minute, r["node"], r["pages"]) for r in run(spark, ps.rates(stream), "rates")}
    assert found == {(0, "n", 2), (1, "n", 2)}
    spark.conf.unset("spark.sql.streaming.checkpointLocation")
