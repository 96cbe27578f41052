"""Page tables derived from the driver's tables; each has a Spark and a DuckDB form of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: In both dialects: a supplier's page text by s_suppkey, over six shapes.
SUPPLIER_TEXT = """CASE s_suppkey % 6
  WHEN 0 THEN '甲方：星河' || CAST(s_suppkey % 17 AS STRING) || '有限公司' || chr(10) || '法定代表人：张 伟'
  WHEN 1 THEN '乙方：星 河 ' || CAST(s_suppkey % 17 AS STRING) || ' 有 限 公司，John Smith signed for Blue Harbor Trading Co., Ltd. today'
  WHEN 2 THEN '（星河' || CAST(s_suppkey % 17 AS STRING) || '股份有限公司）联系人：李 娜' || chr(13) || chr(10) || 'Mary Jane Doe'
  WHEN 3 THEN '   ' || chr(10) || chr(9)
  WHEN 4 THEN '星河' || CAST(s_suppkey % 17 AS STRING) || '有限公司分公司 与 星河' || CAST(s_suppkey % 17 AS STRING) || '有限公司'
  ELSE 'ＡＢＣ　星河' || CAST(s_suppkey % 17 AS STRING) || '有限公司；出卖人：本公司' END"""


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): five suppliers make a document."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.expr("s_suppkey div 5").alias("doc_id"), F.expr("cast(s_suppkey % 5 + 1 AS int)").alias("page"), F.expr(SUPPLIER_TEXT).alias("text"))


SUPPLIER_PAGES = f"sp AS (SELECT s_suppkey // 5 AS doc_id, CAST(s_suppkey % 5 + 1 AS INTEGER) AS page, {SUPPLIER_TEXT} AS text FROM supplier)"


#: In both dialects: a customer's page text by c_custkey, with names of persons and companies in many positions.
_SUR = "substr('赵钱孙李周吴郑王冯陈司晴卫欧', CAST(c_custkey % 14 + 1 AS INTEGER), 1)"
_K = "CAST(c_custkey % 5 AS STRING)"
NAME_TEXT = f"""CASE c_custkey % 17
  WHEN 0 THEN '联系人：' || {_SUR} || '建明 电话。海光' || {_K} || '集团' WHEN 1 THEN {_SUR} || '晓东先生与欧阳娜娜签字，' || {_SUR} || '晓东' WHEN 2 THEN '买方为' || {_SUR} || '宁体育用品有限公司，系第三方'
  WHEN 3 THEN '经办人 ' || {_SUR} || '文' || chr(10) || '日期' WHEN 4 THEN '甲方为海光' || {_K} || '集团有限公司及其子公司' WHEN 5 THEN {_SUR} || '强有限公司' WHEN 6 THEN '，司马' || {_SUR} || '。司马相如' || chr(10)
  WHEN 7 THEN '海光' || {_K} || '集团股份有限公司 海光' || {_K} || '集团' WHEN 8 THEN '法定代表人：' || {_SUR} || '某某' WHEN 9 THEN '由' || {_SUR} || '立国主任签发，' || {_SUR} || '立国，本院大学附属医院'
  WHEN 10 THEN ' ' || chr(9) WHEN 11 THEN {_SUR} || '平' || chr(10) || {_SUR} || '小平·海光' || {_K} || '集团分公司' WHEN 12 THEN '与和丰银行' || {_K} || '支行及中州大学' WHEN 13 THEN 'x ' || {_SUR} || ' 公司名称：东海' || {_K} || '商业银行'
  WHEN 14 THEN '签字：' || {_SUR} || '国强董事长' WHEN 15 THEN '海光' || {_K} || '集团有限公司' ELSE {_SUR} || '海。' || repeat('长', 45) || '研究所' END"""


def name_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): suppliers' pages, and customers' with names, six of them a document."""
    c = table(spark, sf_dir, "customer")
    named = c.select(F.expr("1000000 + c_custkey div 6").alias("doc_id"), F.expr("cast(c_custkey % 6 + 1 AS int)").alias("page"), F.expr(NAME_TEXT).alias("text"))
    return supplier_pages(spark, sf_dir).union(named)


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): a document's lines as its pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "text"))
    return d.select("doc_id", (F.col("at") + 1).alias("page"), "text")


LINE_PAGES = """lp AS (SELECT doc_id, CAST(page AS INTEGER) AS page, lines[page] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""


NAME_PAGES = f"{SUPPLIER_PAGES}, np AS (SELECT * FROM sp UNION ALL SELECT 1000000 + c_custkey // 6, CAST(c_custkey % 6 + 1 AS INTEGER), {NAME_TEXT} FROM customer)"


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): a conversation's turns as its pages, every seventh turn blank."""
    return as_turn_pages(table(spark, sf_dir, "conversations"))


def as_turn_pages(c: DataFrame, *more: str) -> DataFrame:
    text = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), text.alias("text"), *more)


TURN_PAGES = "tp AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' || chr(10) ELSE text END AS text FROM conversations)"


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, stop): line items as page ranges of their orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.expr("l_partkey % 60 + 1").alias("start"), F.expr("l_partkey % 60 + 1 + l_suppkey % 9").alias("stop"))


LINE_RANGES = "lr AS (SELECT l_orderkey AS doc_id, l_partkey % 60 + 1 AS start, l_partkey % 60 + 1 + l_suppkey % 9 AS stop FROM lineitem)"


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, job, node, kind, page, group_id): events as what nodes do with pages."""
    return as_node_events(table(spark, sf_dir, "events"))


def as_node_events(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("seq"), "ts", F.expr("(event_id div 5) % 40").alias("job"), F.expr("user_id % 12").alias("node"), F.expr(KIND).alias("kind"), F.expr("cast((event_id div 7) % 9 + 1 AS int)").alias("page"), F.expr("user_id % 50").alias("group_id"), "value")


KIND = "CASE event_id % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'commit' WHEN 2 THEN 'claim' WHEN 3 THEN 'fail' ELSE 'expire' END"
NODE_EVENTS = f"ne AS (SELECT event_id AS seq, ts, (event_id // 5) % 40 AS job, user_id % 12 AS node, {KIND} AS kind, CAST((event_id // 7) % 9 + 1 AS INTEGER) AS page, user_id % 50 AS group_id, value FROM events)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, start_ms, stop_ms): orders as stages' running times."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("stage"), F.expr("o_orderkey * 3").alias("start_ms"), F.expr("o_orderkey * 3 + 1 + o_custkey % 40").alias("stop_ms"))


INTERVALS = "iv AS (SELECT o_orderpriority AS stage, o_orderkey * 3 AS start_ms, o_orderkey * 3 + 1 + o_custkey % 40 AS stop_ms FROM orders)"
