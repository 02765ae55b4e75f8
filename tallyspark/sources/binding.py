"""Canonical events and persons over star-schema tables and the event log.

Two bindings give the same columns: ``purchases`` joins orders, line items, parts and places (many rows of a customer
share a date), ``clicks`` takes the event log (no ties). ``us`` is wall-clock time in microseconds, ``seq`` a key that
completes the order of a customer's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_us(ts: Column) -> Column:
    """Microseconds of a zone-less time, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("customer_id"),
        wall_us(F.col("ts")).alias("us"),
        F.get_json_object("props", "$.k").alias("asin"),
        F.col("event_type").alias("category"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("seq"),
    )


CLICKS = """SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_us(ts) AS us, regexp_extract(props, '"k": ?([^,}]+)', 1) AS asin,
  event_type AS category, value AS price, 1.0::DOUBLE AS quantity, lpad(CAST(event_id AS VARCHAR), 12, '0') AS seq FROM events"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item. The part, customer and nation sides are dimensions; Spark picks the join by their size.

    Lines meet their order last, so they are dealt twice at most and lie by order then, as windows over an order need them.
    """
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    place = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    seq = F.concat(
        pad(F.col("l_orderkey"), 12),
        pad(F.col("l_linenumber"), 3),
        pad(F.col("l_partkey"), 12),
        pad(F.col("l_suppkey"), 10),
        pad(F.round(F.col("l_extendedprice") * 100).cast("long"), 14),
    )
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(order.join(place, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            wall_us(F.col("o_orderdate")).alias("us"),
            F.col("l_partkey").cast("string").alias("asin"),
            F.col("p_type").alias("category"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"),
            seq.alias("seq"),
            F.col("p_name").alias("title"),
            F.col("n_name").alias("state"),
            F.col("o_orderkey").alias("order_id"),
        )
    )


PURCHASES = """SELECT CAST(o_custkey AS VARCHAR) AS customer_id, epoch_us(o_orderdate) AS us, CAST(l_partkey AS VARCHAR) AS asin, p_type AS category,
  l_extendedprice / l_quantity AS price, l_quantity AS quantity,
  lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
    || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0') AS seq,
  p_name AS title, n_name AS state, o_orderkey AS order_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey rows: one for each customer of the star schema."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("Respondent ID"),
        F.col("c_mktsegment").alias("Q-segment"),
        F.col("c_acctbal").alias("Q-balance"),
        F.col("c_nationkey").alias("Q-nation"),
        F.lit(None).cast("string").alias("Q-empty"),
    )
