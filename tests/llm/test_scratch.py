"""What tables between steps leave on disk."""

from pyspark.sql import functions as F

from pagewright.llm.scratch import materialize


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_shuffles_go_with_the_write(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 700)
    df = rows.groupBy("k").count().join(rows, "k").repartition(3, "id")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name)
    made = materialize(df, "table")
    assert not shuffle_files(spark) - before and spark.conf.get(name) == setting
    assert made.count() == df.count() == 5000  # df runs again
    assert materialize(df, "again").count() == 5000
