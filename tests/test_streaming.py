"""Micro-batches give what one batch gives."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import alerts as A
from ledgerlens.streaming import arrival as R
from ledgerlens.streaming import detect as D


def _calls(spark):
    quiet = [(1, 2, datetime(2024, 1, 1 + i, 9), 30) for i in range(15)]
    burst = [(1 + i % 2, 2 - i % 2, datetime(2024, 1, 20, 9) + timedelta(minutes=i), 10) for i in range(20)]
    return spark.createDataFrame(quiet + burst, "caller long, callee long, ts timestamp, duration_sec int")


def test_daily_counts_equal_batch(spark, tmp_path):
    calls = _calls(spark)
    calls.repartition(4).write.parquet(str(tmp_path / "in"))
    query = D.daily_counts(D.file_stream(spark, str(tmp_path / "in"), calls.schema)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = calls.groupBy(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"), F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("duration_sec").alias("talk_sec"))
    assert sorted(spark.table("daily").collect()) == sorted(want.collect())


def test_detection_on_arrival_is_idempotent(spark, tmp_path):
    calls = _calls(spark)
    calls.repartition(3).write.parquet(str(tmp_path / "in"))

    def bursts(rows):
        return A.comm_bursts(rows).select(F.concat_ws(":", F.lit("COMM_BURST"), "a", "b", F.col("day").cast("string")).alias("key"), "severity")

    for checkpoint in ("c1", "c2"):  # the second reads everything again and raises nothing
        D.detect_on_arrival(D.file_stream(spark, str(tmp_path / "in"), calls.schema), str(tmp_path / f"store-{checkpoint}"), str(tmp_path / "alerts"), str(tmp_path / checkpoint), [("bursts", bursts)]).awaitTermination()
        assert [r.key for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == ["COMM_BURST:1:2:2024-01-20"]


def test_sessions_close(spark):
    rows = D.sessions(_calls(spark)).where("caller = 1").collect()
    # Fifteen quiet days and the burst, whose calls are minutes apart.
    assert len(rows) == 16 and sum(r.calls for r in rows) == 25


def _transfers(spark):
    """Two accounts with usual days; one bursts on a day, one splits sums just below the ceiling."""
    at = lambda day, minute=0: datetime(2024, 1, 1) + timedelta(days=day, minutes=minute)
    rows = [("A", 100.0 + i % 3, at(i)) for i in range(20)] + [("A", 9000.0, at(25))] + [("B", 200.0 + i, at(i)) for i in range(12)]
    rows += [("B", 49_000.0 + i, at(30 + i, i)) for i in range(4)] + [("B", 46_000.0, at(31)), ("C", 1.0, at(1)), (None, 5.0, at(2)), ("A", None, at(3))]
    return spark.createDataFrame(rows, "from_account string, amount double, ts timestamp")


def _deliver(rows, place, order):
    """rows in as many files as order is long, arriving in that order."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(len(order))))
    for when, part in enumerate(order):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{place}/d{when}")
    return [f"{place}/d{i}" for i in range(len(order))]


def _stood(session, place, folders, schema, changes):
    """What stands after the deliveries, each a batch of its own."""
    for folder in folders:
        session.read.schema(schema).parquet(folder).coalesce(1).write.mode("append").parquet(f"{place}/in")
        changes(session.readStream.schema(schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint")
    return R.standing(session.read.parquet(f"{place}/out"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_alerts_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    session, txn, calls = R.stateful_session(spark), _transfers(spark), _calls(spark)
    own = _stood(session, tmp_path / "t", _deliver(txn, tmp_path / "ts", order), txn.schema, lambda s, out, c: R.keep_changes(R.account_changes(s), out, c).awaitTermination())
    pairs = _stood(session, tmp_path / "c", _deliver(calls, tmp_path / "cs", order), calls.schema, lambda s, out, c: R.keep_changes(R.pair_changes(s), out, c).awaitTermination())
    full = txn.where("from_account is not null and amount is not null").withColumns({c: F.lit(0) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})
    want = A.alerts(full, calls)
    assert sorted(own.unionByName(pairs).select(*want.columns).collect()) == sorted(want.collect())
    assert {r.kind for r in want.collect()} == {"STRUCTURING", "TRANSACTION_SPIKE", "COMM_BURST"}


@pytest.mark.parametrize("order", ["rro", "orr", "roro"])
def test_late_owners_reach_earlier_records(spark, tmp_path, order):
    session = R.stateful_session(spark)
    schemas = {"r": "record long, side string, identifier string", "o": "identifier string, owner string, seq long"}
    records = [(i, side, f"n{i % 4}") for i in range(12) for side in ("from", "to")] + [(99, "from", None)]
    owners = [("n0", "Ann", 1), ("n1", "Bea", 1), ("n1", "Cy", 2), ("n2", "Di", 1), ("n9", "Ed", 1), (None, "Fy", 1)]
    whole = {"r": records, "o": owners}
    for kind in "ro":
        session.createDataFrame([], schemas[kind]).write.mode("append").parquet(f"{tmp_path}/{kind}")
    for when, kind in enumerate(order):
        n = order.count(kind)
        rows = whole[kind][order[:when].count(kind) :: n]
        session.createDataFrame(rows, schemas[kind]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}")
        streams = [session.readStream.schema(schemas[k]).parquet(f"{tmp_path}/{k}") for k in "ro"]
        R.keep_changes(R.link_changes(*streams), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = {(r.record, r.side): r.owner for r in R.standing(session.read.parquet(f"{tmp_path}/out")).collect()}
    want = {"n0": "Ann", "n1": "Cy", "n2": "Di"}
    assert found == {(i, s): want[n] for i, s, n in records if n in want}


def test_entrants_to_the_top_are_told_once(spark, tmp_path):
    schema = "src long, dst long, weight long"
    path = lambda a, b: [(i, i + 1, 1) for i in range(a, b)]
    for edges in (path(0, 6), path(6, 14), [(20, 21, 1)]):
        spark.createDataFrame(edges, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        R.watch_top(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/alerts", f"{tmp_path}/checkpoint").awaitTermination()
    # A chain's middle: 1 to 5 at first, then 5 to 9 of the longer one.
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/alerts").collect()} == {6, 7, 8, 9}
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 4


class _Held:
    """A value or map of the state store, in memory, that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def _ask(self, result):
        self.calls.append(1)
        return result

    def exists(self):
        return self._ask(bool(self.held))

    def get(self):
        return self._ask(self.held[()])

    def update(self, value):
        self._ask(self.held.update({(): value}))

    def containsKey(self, key):  # noqa: N802
        return self._ask(key in self.held)

    def getValue(self, key):  # noqa: N802
        return self._ask(self.held[key])

    def updateValue(self, key, value):  # noqa: N802
        self._ask(self.held.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._ask(self.held.pop(key))

    def iterator(self):
        return self._ask(iter(list(self.held.items())))


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):  # noqa: N802
        return _Held(self.calls)

    def getMapState(self, *_):  # noqa: N802
        return _Held(self.calls)


def _records(ids, side="from"):
    return pd.DataFrame({"record": np.array(ids, np.int64), "side": side, "owner": None, "seq": 0})


def test_state_is_not_asked_for_each_record():
    handle, links = _Handle(), R.Links()
    links.init(handle)
    owner = lambda name, seq: pd.DataFrame({"record": [0], "side": [""], "owner": [name], "seq": [seq]})
    batches = [[_records(range(15_000)), _records([5, 6], None)], [owner("Ann", 1)], [_records(range(14_000, 25_000))], [owner("Bea", 2), _records([7, 25_000])], [owner("Old", 1)]]
    told = [pd.concat([pd.DataFrame(columns=["record", "side", "owner", "op"]), *links.handleInputRows(("n",), iter(b), None)]) for b in batches]
    assert [len(t) for t in told] == [0, 15_002, 10_000, 2 * 25_002 + 1, 0]
    stands = pd.concat(told).fillna({"side": "?"}).groupby(["record", "side", "owner"])["op"].sum()
    stands = stands[stands != 0]
    assert (stands == 1).all() and set(stands.index.get_level_values("owner")) == {"Bea"} and len(stands) == 25_003
    assert len(handle.calls) < 60


def test_state_is_not_asked_for_each_day():
    handle, accounts = _Handle(), R.AccountAlerts()
    accounts.init(handle)
    days = np.arange(300)
    frame = pd.DataFrame({"us": days * 86_400_000_000, "day": days, "cents": 10_000 + days % 3, "band": False})
    for rows in (frame[days % 2 == 0], frame[days % 2 == 1], frame.tail(1).assign(cents=900_000)):
        told = list(accounts.handleInputRows(("A",), iter([rows]), None))
    assert [tuple(r) for r in told[0].itertuples(index=False)] == [("TRANSACTION_SPIKE", "high", "TRANSACTION_SPIKE:A:1970-10-27", "A", 1)]
    assert len(handle.calls) < 30
