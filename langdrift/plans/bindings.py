"""The driver's tables in the roles of corpus tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, member, date, party, con of orders and customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").alias("con"), F.col("o_orderpriority").alias("section"), F.col("o_totalprice").alias("price"))


def token_texts(spark: SparkSession, sf_dir: str, word: str = "l_suppkey") -> DataFrame:
    """Contributions with the tokens of their line items in a total order."""
    items = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    texts = items.groupBy(F.col("l_orderkey").alias("uid")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_t"))
    texts = texts.select("uid", F.transform("_t", lambda t: F.concat(F.lit("w"), t[word].cast("string"))).alias("tokens"))
    return contributions(spark, sf_dir).join(texts, "uid")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated texts with a member, party (language) and section (source)."""
    d = table(spark, sf_dir, "documents")
    date = F.date_add(F.lit("2015-05-01").cast("date"), (F.col("doc_id") % 1700).cast("int"))
    return d.select(F.col("doc_id").alias("uid"), "text", F.col("lang").alias("party"), F.col("source").alias("section"), date.alias("date"), (F.col("doc_id") % 97).alias("member"))


CONTRIBUTIONS = """contrib AS (
  SELECT o_orderkey AS uid, o_custkey AS member, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS party, c_nationkey AS con, o_orderpriority AS section, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TOKENS = f"""{CONTRIBUTIONS}, texts AS (
  SELECT uid, member, date, party, con, section, tokens FROM contrib JOIN (
    SELECT l_orderkey AS uid, list('w' || CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS tokens FROM lineitem GROUP BY 1) USING (uid))"""
WORDS = f"""{TOKENS}, words AS (SELECT uid, member, date, party, con, section, unnest(tokens) AS word FROM texts)"""


def windows_sql(source: str, size: int, step: int) -> str:
    """placed (window_no, window_start, and the source's columns): row windows in the order (date, uid)."""
    return f"""pos AS (SELECT *, row_number() OVER (ORDER BY date, uid) - 1 AS position, count(*) OVER () AS total FROM {source}),
  wins AS (SELECT CAST(i AS BIGINT) AS window_no, i * {step} AS lo FROM range((SELECT CAST(greatest(ceil((max(total) - {size}) / {step}), 0) AS BIGINT) FROM pos)) t(i)),
  placed0 AS (SELECT w.window_no, p.* EXCLUDE (position, total) FROM pos p JOIN wins w ON p.position >= w.lo AND p.position < w.lo + {size}),
  placed AS (SELECT *, min(date) OVER (PARTITION BY window_no) AS window_start FROM placed0)"""
