"""Pairs by name, number and wording where many rows share a key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import resolution as R


def test_candidates_by_name_are_not_grouped_again(spark):
    people = [(i, i % 3, f"name {i % 4}" if i % 7 else None) for i in range(40)]
    shared = [(1, 5), (5, 1), (2, 7), (3, 6), (0, 4), (0, 4), (8, 20)]
    found = R.identity_candidates(spark.createDataFrame(people, "person long, case_id long, tokens string"), spark.createDataFrame(shared, "person_a long, person_b long"))
    numbers, want = {tuple(sorted(s)) for s in shared}, set()
    for a, ca, ta in people:
        for b, cb, tb in people:
            by_name, by_number = ta is not None and ta == tb, (a, b) in numbers
            if a < b and ca != cb and (by_name or by_number):
                want.add((a, b, by_name, by_number))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and (1, 5, True, True) in want
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_wordings_are_compared_once_each(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([S._ratio(x, y) for x, y in zip(a, b, strict=True)])

    from ledgerlens.plans import QUERIES

    monkeypatch.setattr(S, "indel_ratio", ratio)
    sf = "/root/testdata/sf0.01"
    found = QUERIES["lineage_near_verbatim"](spark, sf).count()
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    kinds = {}
    for p in parts:
        kinds.setdefault((p.p_brand + p.p_name[:1], " ".join((p.p_name + " " + p.p_type).lower().split())), []).append(p.p_partkey)
    several = [(k, w, v) for (k, w), v in kinds.items()]
    pairs = [(len(v), len(u)) for i, (k, w, v) in enumerate(several) for j, x, u in several[:i] if j == k and S._ratio(w, x) >= 85]
    assert found == sum(n * m for n, m in pairs) + sum(len(v) * (len(v) - 1) // 2 for v in kinds.values())
    assert 0 < compared.value <= sum(1 for i, (k, *_) in enumerate(several) for j, *_ in several[:i] if j == k)


def test_repeated_rows_are_merged_not_broadcast(spark):
    rows = spark.createDataFrame([(i, "p", f"red bolt {i % 3}") for i in range(30)], "id long, proposition string, words string")
    found = R.near_verbatim(rows)
    assert found.count() == 30 * 29 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
