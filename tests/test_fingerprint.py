"""Canonical JSON against Python's, and digests that do not depend on order or partitions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ledgerlens.operators import fingerprint as P


def test_canonical_json_equals_pythons(spark):
    values = [
        {"z": 'say "hi"\\', "a": [1, None, -3], "m": {"b": "é日", "a": "\U0001f600", "ab": "x"}, "t": True},
        {"z": "line\nend\t\r\x01\x7f", "a": [], "m": {}, "t": None},
        {"z": None, "a": None, "m": {"k": None}, "t": False},
        {"z": "", "a": [7], "m": None, "t": True},
    ]
    schema = "v struct<z: string, a: array<int>, m: map<string, string>, t: boolean>"
    frame = spark.createDataFrame([(v,) for v in values], schema)
    found = [r.j for r in frame.select(P.canonical_json(F.col("v"), frame.schema["v"].dataType).alias("j")).collect()]
    assert sorted(found) == sorted(json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values)


def test_digests_and_differences(spark):
    rows = [(i, f"name {i % 7}") for i in range(400)] + [(5, "name 5")]
    frame = spark.createDataFrame(rows, "id long, name string")
    tree = {r.node: (r.n, r.digest) for r in P.digests(frame, ["id"]).collect()}
    again = P.digests(frame.orderBy(F.desc("id")).repartition(7).select("name", "id"), ["id"])
    assert tree == {r.node: (r.n, r.digest) for r in again.collect()} and tree[""][0] == 401
    changed = [(i, n if i != 77 else "other") for i, n in rows if i != 300][:-1] + [(999, "new")]
    found = {r.name: (r.n_one, r.n_other) for r in P.differences(frame, spark.createDataFrame(changed, "id long, name string"), ["id"]).collect()}
    name = lambda i: hashlib.sha256(f'"id":{i}'.encode()).hexdigest()
    assert found == {name(77): (1, 1), name(300): (1, 0), name(5): (2, 1), name(999): (0, 1)}
    assert P.differences(frame, frame.repartition(3), ["id"]).count() == 0
