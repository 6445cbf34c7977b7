"""Where queries and their DuckDB SQL are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The adapters' SQL, for use as common table expressions.
TXN = """txn AS (SELECT 'S' || l_suppkey AS from_account, 'C' || o_custkey AS to_account, l_extendedprice AS amount, l_shipdate AS ts,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CALLS = """calls AS (SELECT event_id, user_id AS caller, (user_id + CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN n - 1 WHEN 2 THEN 2 ELSE n - 2 END) % n AS callee, ts,
  trunc(value)::BIGINT AS duration_sec
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events), (SELECT max(user_id) + 1 AS n FROM events))"""
CONTACTS = """seen AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k, date_trunc('hour', ts) AS h, user_id FROM events),
linked AS (SELECT lag(user_id) OVER (PARTITION BY k, h ORDER BY user_id) AS src, user_id AS dst FROM seen),
contacts AS (SELECT src, dst, count(*)::BIGINT AS weight FROM linked WHERE src IS NOT NULL GROUP BY ALL)"""
ARCS = "arcs AS (SELECT src, dst, weight FROM contacts UNION ALL SELECT dst, src, weight FROM contacts)"
HOLDINGS = """users AS (SELECT DISTINCT user_id AS u, (SELECT max(user_id) + 1 FROM events) AS n FROM events),
holdings AS (
  SELECT 'A' || u AS holding, u AS person, u AS identifier, 'record' AS kind, NULL::TIMESTAMP AS starts, TIMESTAMP '2024-01-16' AS ends FROM users
  UNION ALL SELECT 'B' || u, u + n, u, 'record', TIMESTAMP '2024-01-18', NULL FROM users
  UNION ALL SELECT 'C' || u, u + 2 * n, u, 'claim', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-18' FROM users WHERE u % 5 = 0)"""
