"""The shared test tables in the shapes of case records.

Every adapter is a projection (and at most one key join) of the stored tables, so
filters and column choices of a query reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers from a supplier's account to a customer's, one for each line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("from_account"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("to_account"),
        F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def _users(events: DataFrame) -> int:
    return (events.agg(F.max("user_id")).first()[0] or 0) + 1


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from an event's user to a neighbour in the ring of users."""
    events = table(spark, sf_dir, "events")
    n, k = _users(events), F.get_json_object("props", "$.k").cast("long")
    step = F.when(k % 4 == 0, 1).when(k % 4 == 1, n - 1).when(k % 4 == 2, 2).otherwise(n - 2)
    return events.select("event_id", F.col("user_id").alias("caller"), ((F.col("user_id") + step) % n).alias("callee"), "ts", F.col("value").cast("long").alias("duration_sec"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges (src < dst, weight) between users next to each other among those who share a property value in an hour.

    Each hour and value links its users in the order of their ids, so the edges
    never outnumber the events; weight counts the hours and values that link a pair.
    """
    seen = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"), F.date_trunc("hour", "ts").alias("hour"), "user_id").distinct()
    linked = seen.select(F.lag("user_id").over(Window.partitionBy("k", "hour").orderBy("user_id")).alias("src"), F.col("user_id").alias("dst"))
    return linked.where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def holdings(spark: SparkSession, sf_dir: str, claim_days: int = 7) -> DataFrame:
    """(holding, person, identifier, kind, starts, ends): who holds which number when; half-open, null is unbounded.

    Two records for each user's number, one before and one after it changed
    hands, and for every fifth user a claim that covers claim_days on either side
    of its stated date.
    """
    events = table(spark, sf_dir, "events")
    n = _users(events)
    users = events.select("user_id").distinct()
    stamp = lambda text: F.to_timestamp(F.lit(text))
    never = F.lit(None).cast("timestamp")
    before = users.select(F.concat(F.lit("A"), "user_id").alias("holding"), F.col("user_id").alias("person"), F.col("user_id").alias("identifier"), F.lit("record").alias("kind"), never.alias("starts"), stamp("2024-01-16 00:00:00").alias("ends"))
    after = users.select(F.concat(F.lit("B"), "user_id").alias("holding"), (F.col("user_id") + n).alias("person"), F.col("user_id").alias("identifier"), F.lit("record").alias("kind"), stamp("2024-01-18 00:00:00").alias("starts"), never.alias("ends"))
    day = stamp("2024-01-10 00:00:00")
    width = F.make_dt_interval(F.lit(claim_days))
    claim = users.where("user_id % 5 = 0").select(
        F.concat(F.lit("C"), "user_id").alias("holding"), (F.col("user_id") + 2 * n).alias("person"), F.col("user_id").alias("identifier"), F.lit("claim").alias("kind"),
        (day - width).alias("starts"), (day + width + F.make_dt_interval(F.lit(1))).alias("ends"),
    )
    return before.unionByName(after).unionByName(claim)
