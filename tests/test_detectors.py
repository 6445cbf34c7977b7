"""Boundary rows of the detectors."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from ledgerlens.operators import alerts as A

START = datetime(2024, 3, 1, 10)


def transfers(spark, rows):
    return spark.createDataFrame([(a, "T", float(x), t, i, 1, 1, 1) for i, (a, x, t) in enumerate(rows)], "from_account string, to_account string, amount double, ts timestamp, l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int")


def days(n):
    return START + timedelta(days=n)


def test_four_transfers_below_the_ceiling(spark):
    found = A.structuring(transfers(spark, [("a", 48_000, days(i)) for i in range(4)])).collect()
    assert [(r.transfers, r.total, r.first_day, r.span_days) for r in found] == [(4, 192_000.0, date(2024, 3, 1), 4)]


@pytest.mark.parametrize("rows", [
    [("a", 50_000, days(i)) for i in range(4)],
    [("a", 44_999.99, days(i)) for i in range(4)],
    [("a", 48_000, days(10 * i)) for i in range(4)],
    [("a", 48_000, days(0)), ("a", 48_000, days(1))],
])
def test_no_structuring(spark, rows):
    assert A.structuring(transfers(spark, rows)).count() == 0


def test_window_is_inclusive_and_first_of_the_widest_wins(spark):
    rows = [("a", 46_000, days(i)) for i in (0, 3, 7, 20, 23, 27)]
    found = A.structuring(transfers(spark, rows)).first()
    assert (found.transfers, found.first_day, found.span_days) == (3, date(2024, 3, 1), 8)


def test_one_spike_after_quiet_days(spark):
    rows = [("a", 1000 + 10 * i, days(i)) for i in range(10)] + [("a", 200_000, days(20))]
    found = A.transaction_spikes(transfers(spark, rows)).collect()
    assert [(r.day, r.severity) for r in found] == [(date(2024, 3, 21), "high")]
    assert A.transaction_spikes(transfers(spark, rows[-2:])).count() == 0


def test_spikes_on_structured_days_are_suppressed(spark):
    rows = [("a", 1000 + 10 * i, days(i)) for i in range(10)] + [("a", 48_000, days(20) + timedelta(hours=h)) for h in range(3)]
    txn = transfers(spark, rows)
    assert A.transaction_spikes(txn).count() == 1
    assert A.transaction_spikes(txn, suppressed=A.structuring_days(txn)).count() == 0


def test_suppression_reads_twelve_evidence_rows_only(spark):
    txn = transfers(spark, [("a", 46_000, days(i / 3)) for i in range(18)])
    assert A.structuring(txn).first().transfers == 18
    assert A.structuring_days(txn).count() == 5


def test_constant_days_have_no_deviation(spark):
    z = A.robust_z(A.daily_totals(transfers(spark, [("a", 100, days(i)) for i in range(6)])), ["from_account"], "total")
    assert {r.z for r in z.collect()} == {0.0}


def calls(spark, rows):
    return spark.createDataFrame(rows, "caller long, callee long, ts timestamp, duration_sec int")


def test_burst_in_either_direction(spark):
    quiet = [(1, 2, days(i), 30) for i in range(15)]
    burst = [(1 + i % 2, 2 - i % 2, days(20) + timedelta(minutes=i), None if i == 0 else 10) for i in range(20)]
    found = A.comm_bursts(calls(spark, quiet + burst)).collect()
    assert [(r.a, r.b, r.calls, r.talk_sec) for r in found] == [(1, 2, 20, 190)]
    assert A.comm_bursts(calls(spark, quiet)).count() == 0


def test_a_second_run_raises_nothing(spark):
    txn = transfers(spark, [("a", 48_000, days(i)) for i in range(4)])
    found = A.alerts(txn, calls(spark, []))
    assert found.count() == 1
    assert A.new_alerts(found, found).count() == 0


def test_a_z_on_the_threshold_counts_in_any_order(spark):
    import itertools

    from ledgerlens.streaming.arrival import robust_scores

    counts = [1] * 12 + [2] * 5 + [3, 4, 5]  # five is exactly three deviations above the mean
    orders = [counts[i:] + counts[:i] for i in range(20)] + [counts[::-1]]
    assert all(robust_scores(np.array(o, float)).max() == 3.0 for o in orders)
    rows = list(itertools.chain.from_iterable([(key, day, n) for day, n in enumerate(order)] for key, order in enumerate(orders)))
    daily = spark.createDataFrame(rows, "a int, day int, calls long").coalesce(1)
    assert [r.z for r in A.robust_z(daily, ["a"], "calls").where("calls = 5").collect()] == [3.0] * 21
