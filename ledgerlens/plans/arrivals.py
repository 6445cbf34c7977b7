"""Queries over streams of the shared tables: deliveries in an order that the results must not show."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import calls, table, transactions
from ..sources.storage import checkpoint_root
from ..streaming import arrival
from ..streaming.detect import trailing_counts as trailing
from .alerts import ENVELOPE
from .evidence import OWNERS
from .registry import CALLS, TXN, query

DELIVERIES = 3


def _delivered(spark: SparkSession, tables: dict[str, DataFrame], order: list[tuple[str, int]], changes: Callable[..., DataFrame]) -> DataFrame:
    """What stands after the tables' parts (name, number) have been delivered one after another, each a batch of its own."""
    session, place = arrival.stateful_session(spark), f"{checkpoint_root(spark)}/ledgerlens/arrivals-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(DELIVERIES))).write.partitionBy("part").parquet(f"{place}/whole/{name}")
        session.createDataFrame([], rows.schema).write.parquet(f"{place}/in/{name}")
    for name, part in order:
        whole = session.read.schema(tables[name].schema).parquet(f"{place}/whole/{name}/part={part}")
        whole.write.mode("append").parquet(f"{place}/in/{name}")
        streams = [session.readStream.schema(rows.schema).parquet(f"{place}/in/{n}") for n, rows in tables.items()]
        arrival.keep_changes(changes(*streams), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return arrival.standing(spark.read.schema(session.read.parquet(f"{place}/out").schema).parquet(f"{place}/out"))


@query(f"{ENVELOPE} SELECT kind, severity, key, subject FROM alerts WHERE kind <> 'COMM_BURST'")
def arrival_account_alerts(spark, sf_dir):
    """Structuring and spikes from transfers that arrive in parts, the middle one last."""
    txn = transactions(spark, sf_dir).select("from_account", "amount", "ts")
    return _delivered(spark, {"txn": txn}, [("txn", 2), ("txn", 0), ("txn", 1)], arrival.account_changes)


@query(f"{ENVELOPE} SELECT kind, severity, key, subject FROM alerts WHERE kind = 'COMM_BURST'")
def arrival_bursts(spark, sf_dir):
    """Bursts from calls that arrive in parts."""
    return _delivered(spark, {"calls": calls(spark, sf_dir).select("caller", "callee", "ts")}, [("calls", 1), ("calls", 2), ("calls", 0)], arrival.pair_changes)


@query(f"WITH {TXN}, {OWNERS} SELECT DISTINCT l_orderkey * 8 + l_linenumber AS record, 'from' AS side, owner FROM txn JOIN owners ON identifier = from_account")
def arrival_links(spark, sf_dir):
    """Owners of transfers where two parts of the transfers come before the owners, and one after."""
    key = F.col("s_suppkey")
    owners = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("S"), key.cast("string")).alias("identifier"), F.col("s_name").alias("owner"), key.cast("long").alias("seq"))
    records = transactions(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("record"), F.lit("from").alias("side"), F.col("from_account").alias("identifier"))
    order = [("records", 0), ("records", 2), *(("owners", i) for i in range(DELIVERIES)), ("records", 1)]
    return _delivered(spark, {"records": records, "owners": owners}, order, arrival.link_changes)


@query(f"""WITH {CALLS} SELECT caller, (ts::DATE - back::INT)::DATE AS first_day, count(*) AS calls FROM calls, range(7) r(back) GROUP BY 1, 2""")
def trailing_counts(spark, sf_dir):
    """Calls of each caller in every window of seven days, sliding by a day."""
    return trailing(calls(spark, sf_dir))
