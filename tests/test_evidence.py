"""Restriction equals recomputation; intervals are half-open; lineage survives cycles."""

from __future__ import annotations

from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evidence as E
from ledgerlens.operators import governance as V

T = lambda d, h=0: datetime(2024, 1, d, h)


@pytest.fixture(scope="module")
def data(spark):
    calls = spark.createDataFrame([(1, 7, 8, T(5), 1), (2, 7, 8, T(10), 1), (3, 8, 7, T(20), 1), (4, 7, 9, T(5), 1)], "event_id long, caller long, callee long, ts timestamp, duration_sec int")
    held = spark.createDataFrame([
        ("h1", 1, 7, None, T(10)), ("h2", 2, 7, T(10), None), ("h3", 3, 8, None, None), ("h4", 1, 9, None, None), ("h5", 4, 7, T(4), T(6)),
    ], "holding string, person long, identifier long, starts timestamp, ends timestamp")
    return calls, held


def test_half_open_holdings(data):
    found = {(r.event_id, r.person_a, r.person_b) for r in E.temporal_holder_join(*data).collect()}
    assert found == {(1, 1, 3), (1, 4, 3), (2, 2, 3), (3, 3, 2), (4, 4, 1)}  # nobody calls themselves; an end is outside


def test_restriction_equals_recomputation(spark, data):
    calls, held = data
    derivations = E.edge_derivations(calls, held)
    derivations = derivations.cache()
    holdings = [r.holding for r in held.collect()]
    for size in (1, 2):
        for gone in combinations(holdings, size):
            fast = E.restrict_edges(derivations, spark.createDataFrame([(g,) for g in gone], "atom string"))
            slow = E.call_edges(calls, held.where(~F.col("holding").isin(*gone))).select("src", "dst", "derivations")
            assert sorted(fast.collect()) == sorted(slow.collect()), gone


def test_conflicts_end_with_identity(spark, data):
    assert {r.event_id for r in E.conflicts(*data).collect()} == {1, 4}
    same = E.identity_clusters(spark.createDataFrame([(1, 4)], "a long, b long"))
    assert E.conflicts(*data, same).count() == 0


def test_lineage_roots_and_cycles(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 5), (5, 6), (7, 6)], "derivative long, origin long")
    found = {r.item: r.root for r in E.lineage_roots(links.where("derivative < 5")).collect()}
    assert found == {2: 1, 3: 1, 4: 1}
    assert {r.item: r.root for r in E.lineage_roots(links).collect()} == found | {5: 5, 6: 5, 7: 5}


def test_identity_steps_are_free(spark):
    edges = [(1, 2, 1), (2, 3, 0), (3, 4, 1), (4, 5, 1)]
    frame = spark.createDataFrame(edges + [(b, a, c) for a, b, c in edges], "src long, dst long, cost int")
    found = {r.node: r.cost for r in E.firm_distance(frame, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 2}


def test_access_and_audit(spark):
    now = F.to_timestamp(F.lit("2024-02-01"))
    grants = spark.createDataFrame([("p", "x", 1, None, None), ("p", "x", 2, T(1), None), ("p", "x", 3, None, T(9)), ("q", "y", 1, None, datetime(2025, 1, 1))], "principal string, purpose string, case_id long, revoked_at timestamp, expires_at timestamp")
    assert {(r.principal, r.case_id) for r in V.authorized_cases(grants, now).collect()} == {("p", 1), ("q", 1)}
    asked = spark.createDataFrame([("w", "x", 1), ("v", "x", 1), ("v", "x", 2), ("u", "y", 1)], "workspace string, purpose string, case_id long")
    assert {tuple(r) for r in V.visible_workspaces(asked, grants, now).collect()} == {("w", "p"), ("u", "q")}
    import hashlib

    log, before = [], ""
    for i in range(4):
        digest = hashlib.sha256(f"{before}|{i}|e{i}".encode()).hexdigest()
        log.append([1, i, f"e{i}", before, digest])
        before = digest
    schema = "log_id long, seq long, payload string, prev_hash string, hash string"
    assert V.audit_verify(spark.createDataFrame(log, schema)).count() == 0
    log[2][2] = "changed"
    assert [(r.seq, r.problem) for r in V.audit_verify(spark.createDataFrame(log, schema)).collect()] == [(2, "altered")]
    assert [(r.seq, r.problem) for r in V.audit_verify(spark.createDataFrame(log[:1] + log[3:], schema)).collect()] == [(3, "broken link")]


def test_export_refuses_altered_originals(spark):
    import hashlib

    import pytest

    from ledgerlens.operators import governance as V

    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two"))], "name string, content binary")
    manifest = [(n, hashlib.sha256(c).hexdigest()) for n, c in (("a", b"one"), ("b", b"two"))]
    assert V.export_files(spark.createDataFrame(manifest, "name string, sha256 string"), files).count() == 2
    with pytest.raises(ValueError, match="b is altered"):
        V.export_files(spark.createDataFrame([manifest[0], ("b", "00")], "name string, sha256 string"), files)
