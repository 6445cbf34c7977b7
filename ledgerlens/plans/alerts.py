"""Detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators.ranks import placed
from ..sources.adapters import calls, transactions
from .registry import CALLS, TXN, query

DAILY = "daily AS (SELECT from_account, ts::DATE AS d, round(sum(amount), 2) AS total, count(*) AS transfers FROM txn GROUP BY ALL)"


def _z(source: str, key: str, value: str) -> str:
    return f"""base AS (SELECT *, median({value}) OVER (PARTITION BY {key}) AS med, avg({value}) OVER (PARTITION BY {key}) AS mean,
  stddev_pop({value}) OVER (PARTITION BY {key}) AS dev, count(*) OVER (PARTITION BY {key}) AS days_active FROM {source}),
scored AS (SELECT *, median(abs({value} - med)) OVER (PARTITION BY {key}) AS mad FROM base WHERE days_active >= 5),
zs AS (SELECT *, CASE WHEN mad > 0 THEN ({value} - med) / (1.4826 * mad) WHEN dev > 0 THEN ({value} - mean) / dev ELSE 0 END AS z FROM scored)"""


BAND = "band AS (SELECT *, epoch_us(ts) AS us FROM txn WHERE amount >= 45000 AND amount < 50000)"
WIDEST = BAND + """, counted AS (SELECT *, count(*) OVER (PARTITION BY from_account ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n FROM band),
best AS (SELECT from_account, max(n) AS n FROM counted GROUP BY 1 HAVING max(n) >= 3),
ends AS (SELECT c.from_account, min(us) AS end_us FROM counted c JOIN best b ON c.from_account = b.from_account AND c.n = b.n GROUP BY 1),
runs AS (SELECT b.* FROM band b JOIN ends e USING (from_account) WHERE us BETWEEN end_us - 604800000000 AND end_us)"""
DAYS = """sdays AS (SELECT DISTINCT from_account, ts::DATE AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY from_account ORDER BY us, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount) AS rn FROM runs) WHERE rn <= 12)"""
SPIKES = f"""{DAILY}, {_z("daily", "from_account", "total")},
spikes AS (SELECT from_account, d AS day, total, transfers::BIGINT AS transfers, round(z, 2) AS z, CASE WHEN z >= 5 THEN 'high' ELSE 'medium' END AS severity FROM zs WHERE z >= 3)"""
STRUCT = """struct_runs AS (SELECT from_account, count(*) AS transfers, round(sum(amount), 2) AS total, min(ts)::DATE AS first_day, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS span_days FROM runs GROUP BY 1)"""
BURSTS = f"""pairs AS (SELECT least(caller, callee) AS a, greatest(caller, callee) AS b, ts::DATE AS d, count(*) AS calls, sum(coalesce(duration_sec, 0))::BIGINT AS talk_sec
  FROM calls WHERE caller <> callee GROUP BY ALL), {_z("pairs", "a, b", "calls").replace("base AS", "pbase AS").replace("FROM base", "FROM pbase").replace("scored", "pscored").replace("zs AS", "pzs AS")},
bursts AS (SELECT a, b, d AS day, calls, talk_sec, round(z, 2) AS z, CASE WHEN z >= 5 THEN 'high' ELSE 'medium' END AS severity FROM pzs WHERE z >= 3 AND calls >= 5)"""
ENVELOPE = f"""WITH {TXN}, {CALLS}, {WIDEST}, {DAYS}, {SPIKES}, {STRUCT}, {BURSTS}, alerts AS (
  SELECT 'STRUCTURING' AS kind, 'high' AS severity, 'STRUCTURING:' || from_account || ':' || first_day AS key, from_account AS subject FROM struct_runs
  UNION ALL SELECT 'TRANSACTION_SPIKE', severity, 'TRANSACTION_SPIKE:' || from_account || ':' || day, from_account FROM spikes s WHERE NOT EXISTS (SELECT 1 FROM sdays x WHERE x.from_account = s.from_account AND x.d = s.day)
  UNION ALL SELECT 'COMM_BURST', severity, 'COMM_BURST:' || a || ':' || b || ':' || day, a || '-' || b FROM bursts)"""


@query(f"WITH {TXN}, {DAILY}, {_z('daily', 'from_account', 'total')} SELECT from_account, d AS day, total, round(z, 2) AS z FROM zs")
def robust_z(spark, sf_dir):
    found = A.robust_z(A.daily_totals(transactions(spark, sf_dir)), ["from_account"], "total")
    return found.select("from_account", "day", "total", F.round("z", 2).alias("z"))


@query(f"WITH {TXN}, {SPIKES} SELECT * FROM spikes")
def transaction_spikes(spark, sf_dir):
    return A.transaction_spikes(transactions(spark, sf_dir))


@query(f"WITH {TXN}, {WIDEST}, {DAYS}, {SPIKES} SELECT s.* FROM spikes s LEFT JOIN sdays x ON x.from_account = s.from_account AND x.d = s.day WHERE x.d IS NULL")
def suppressed_spikes(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    return A.transaction_spikes(txn, suppressed=A.structuring_days(txn))


@query(f"WITH {TXN} SELECT from_account, count(*) AS transfers, round(sum(amount), 2) AS total FROM txn WHERE amount >= 45000 AND amount < 50000 GROUP BY 1")
def structuring_band(spark, sf_dir):
    return A.structuring_band(transactions(spark, sf_dir)).groupBy("from_account").agg(F.count("*").alias("transfers"), F.round(F.sum("amount"), 2).alias("total"))


@query(f"WITH {TXN}, {WIDEST}, {STRUCT} SELECT * FROM struct_runs")
def structuring(spark, sf_dir):
    return A.structuring(transactions(spark, sf_dir))


@query(f"WITH {TXN}, {WIDEST}, {DAYS} SELECT from_account, d AS day FROM sdays")
def structuring_days(spark, sf_dir):
    return A.structuring_days(transactions(spark, sf_dir))


@query(f"WITH {CALLS}, {BURSTS} SELECT * FROM bursts")
def comm_bursts(spark, sf_dir):
    return A.comm_bursts(calls(spark, sf_dir))


def _alerts(spark, sf_dir):
    return A.alerts(transactions(spark, sf_dir), calls(spark, sf_dir))


@query(f"{ENVELOPE} SELECT * FROM alerts WHERE kind <> 'STRUCTURING'")
def new_alerts(spark, sf_dir):
    """Alerts not stored yet, when the structuring ones are."""
    found = _alerts(spark, sf_dir)
    return A.new_alerts(found, found.where("kind = 'STRUCTURING'"))


@query(f"{ENVELOPE} SELECT kind, severity, count(*) AS alerts FROM alerts GROUP BY 1, 2")
def alert_counts(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("alerts"))


@query(f"{ENVELOPE} SELECT key, severity, kind, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, key DESC) AS place FROM alerts")
def alert_queue(spark, sf_dir):
    """The whole queue, by severity."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return placed(_alerts(spark, sf_dir).select("key", "severity", "kind"), [rank, F.desc("key")])
