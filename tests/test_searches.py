"""Searches by units against plain shortest ways."""

from __future__ import annotations

import random
from pathlib import Path

from ledgerlens.operators import evidence as E
from ledgerlens.operators import findings as C
from ledgerlens.operators.searches import Units
from ledgerlens.sources.storage import checkpoint_root

EDGES = "src long, dst long, cost int"


def plain(edges, start, limit, blocked=()):
    best, queue = {start: 0}, [start]
    while queue:
        v = queue.pop(0)
        if best[v] and v in blocked:
            continue
        for a, b, c in edges:
            if a == v and best[v] + c <= limit and best[v] + c < best.get(b, limit + 1):
                best[b] = best[v] + c
                queue.append(b)
    return best


def test_costs_with_and_without_blocked_nodes(spark):
    for seed in range(3):
        draw = random.Random(seed)
        half = {(draw.randrange(24), draw.randrange(24), draw.randrange(2)) for _ in range(30)}
        edges = sorted(half | {(b, a, c) for a, b, c in half})
        blocked = draw.sample(range(24), 8)
        e, starts = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i, i) for i in (*range(0, 24, 3), 99)], "a long, node long")
        for stops in ((), blocked):
            found = Units(e, spark.createDataFrame([(b,) for b in blocked], "node long") if stops else None).costs(starts, ["a"], 3).collect()
            want = {(a, n, c) for a in (*range(0, 24, 3), 99) for n, c in plain(edges, a, 3, stops).items()}
            assert len(found) == len(want) and {(r.a, r.node, r.cost) for r in found} == want
        pairs = [(a, b) for a in range(0, 24, 3) for b in range(24) if a < b]
        met = C.pair_distances(e, spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {(r.a, r.b, r.distance) for r in met} == {(a, b, plain(edges, a, 3)[b]) for a, b in pairs if b in plain(edges, a, 3)}


def test_a_long_chain_of_free_steps_takes_few_rounds(spark):
    def tables():
        return len(list(Path(checkpoint_root(spark), "ledgerlens").glob("*")))

    chain = [(i, i + 1, int(i == 40)) for i in range(80)]
    e = spark.createDataFrame(chain + [(b, a, c) for a, b, c in chain], EDGES).coalesce(1)
    begun = tables()
    found = {r.node: r.cost for r in E.firm_distance(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert found == {i: int(i > 40) for i in range(81)}
    assert tables() - begun < 20


def test_pairs_past_blocked_nodes_share_searches_and_leave_no_levels_behind(spark):
    def levels():
        return len(list(Path(checkpoint_root(spark), "ledgerlens").glob("units-reached-*")))

    draw = random.Random(5)
    half = {(draw.randrange(24), draw.randrange(24), draw.randrange(2)) for _ in range(30)}
    edges = sorted(half | {(b, a, c) for a, b, c in half})
    blocked = draw.sample(range(24), 8)
    e, stops = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(b,) for b in blocked], "node long")
    pairs, begun = [(a, b) for a in (*range(0, 24, 3), blocked[0], 99) for b in range(24) if a < b], levels()
    met = C.pair_distances(e, spark.createDataFrame(pairs, "a long, b long"), blocked=stops).collect()
    assert sorted((r.a, r.b, r.distance) for r in met) == sorted({(a, b, plain(edges, a, 3, blocked)[b]) for a, b in pairs if b in plain(edges, a, 3, blocked)})
    C.pair_distances(e, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert levels() == begun


def test_blocked_nodes_that_are_no_goals_are_not_entered(spark):
    edges = [(0, i, 1) for i in range(1, 21)] + [(i, 0, 1) for i in range(1, 21)]
    graph = Units(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i,) for i in range(2, 21)], "node long"))
    start, goals = (spark.createDataFrame(rows, s) for rows, s in (([(0, 0)], "a long, node long"), ([(1,), (2,)], "node long")))
    assert sorted(r.unit for level in graph.search(start, ["a"], 3, goals=goals) for r in level.collect()) == [0, 0, 1, 2]
    assert {(r.node, r.cost) for r in graph.costs(start, ["a"], 3, goals=goals).collect()} == {(1, 1), (2, 1)}
