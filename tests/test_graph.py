"""A planted graph: three cliques of five joined by a broker."""

from __future__ import annotations

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from ledgerlens.operators import graph as G
from ledgerlens.operators.connected import components

BROKER = 100


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(10 * c + a, 10 * c + b, 1) for c in range(3) for a, b in combinations(range(5), 2)] + [(10 * c, BROKER, 1) for c in range(3)]
    return spark.createDataFrame(rows, "src long, dst long, weight long").cache()


def test_broker_leads_betweenness_but_not_degree(edges):
    scores = {r.id: r.betweenness for r in G.betweenness(edges).collect()}
    assert max(scores, key=scores.get) == BROKER
    # Pairs in different cliques all pass the broker: 75 of 105 pairs without it.
    assert scores[BROKER] == pytest.approx(75 / 105)
    degree = {r.id: r.degree for r in G.degree_centrality(edges).collect()}
    assert degree[BROKER] == 3 < degree[0] == 5
    assert [r.id for r in G.key_players(G.betweenness(edges), "betweenness", 2).orderBy("rank").collect()] == [BROKER, 0]


def test_removal_splits_in_three(spark, edges):
    found = {r.id: r for r in G.removal_impacts(edges, spark.createDataFrame([(BROKER,), (1,)], "id long")).collect()}
    assert (found[BROKER].components_before, found[BROKER].components_after, found[BROKER].largest_after) == (1, 3, 5)
    assert found[BROKER].fragmentation_delta == pytest.approx(1 - 5 / 16, abs=1e-4)
    assert (found[1].components_after, found[1].largest_after) == (1, 15)
    assert {r.size for r in G.fragments(edges, spark.createDataFrame([(BROKER,)], "id long")).collect()} == {5}


def test_cut_points(edges):
    assert {r.id for r in G.articulation_points(edges).collect()} == {BROKER, 0, 10, 20}


def test_communities_are_the_cliques(edges):
    labels = G.communities(edges)
    found = {r.id: r.community for r in labels.collect()}
    for c in range(3):
        assert len({found[10 * c + i] for i in range(1, 5)}) == 1
    assert G.modularity(labels, edges) > 0.5


def test_paths(edges):
    assert [r.id for r in G.shortest_path(edges, 1, 24).orderBy("step").collect()] == [1, 0, BROKER, 20, 24]
    assert G.shortest_path(edges, 1, 999).count() == 0


def test_pagerank_sums_to_one(edges):
    ranks = [r["rank"] for r in G.pagerank(edges).collect()]
    assert sum(ranks) == pytest.approx(1)


def test_components_of_a_long_chain(spark):
    chain = spark.range(500).selectExpr("id src", "id + 1 dst")
    assert {r.root for r in components(chain).collect()} == {0}


def _random_edges(spark, rng, nodes, n):
    pairs = sorted({tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(n)})
    return pairs, spark.createDataFrame([(a, b, 1 + (a + b) % 3) for a, b in pairs], "src long, dst long, weight long")


def _components(pairs, without=None):
    nodes = {x for e in pairs for x in e} - {without}
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if without not in (a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize(("nodes", "n"), [(8, 9), (30, 33), (60, 70)])
def test_cut_points_against_removal(spark, nodes, n):
    """Trees, cycles and several components: a cut point is a node whose removal leaves more components."""
    pairs, frame = _random_edges(spark, random.Random(nodes), nodes, n)
    whole = len(set(_components(pairs).values()))
    want = {x for x in _components(pairs) if len(set(_components(pairs, x).values())) > whole}
    assert {r.id for r in G.articulation_points(frame).collect()} == want
    assert {r.node: r.root for r in components(frame).collect()} == _components(pairs)


def test_eigenvector_against_numpy(spark, edges):
    rows = [(r.src, r.dst) for r in edges.collect()]
    ids = sorted({x for e in rows for x in e})
    matrix = np.zeros((len(ids), len(ids)))
    for a, b in rows:
        matrix[ids.index(a), ids.index(b)] = matrix[ids.index(b), ids.index(a)] = 1
    want = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    lone = edges.unionByName(spark.createDataFrame([(500, 501, 1)], "src long, dst long, weight long"))
    found = {r.id: r.eigenvector for r in G.eigenvector(lone).collect()}
    assert [found[i] for i in ids] == pytest.approx(want.tolist(), abs=1e-3)
    assert found[500] == found[501] == 0


def test_pagerank_against_numpy(spark):
    pairs, frame = _random_edges(spark, random.Random(5), 25, 40)
    frame = frame.unionByName(spark.createDataFrame([(90, 91, 0)], "src long, dst long, weight long"))  # edges of no weight: no way out
    ids = sorted({x for e in pairs for x in e} | {90, 91})
    m = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        m[ids.index(a), ids.index(b)] = m[ids.index(b), ids.index(a)] = 1 + (a + b) % 3
    out = m.sum(axis=0)
    x = np.full(len(ids), 1 / len(ids))
    for _ in range(300):
        x = 0.15 / len(ids) + 0.85 * (m @ np.divide(x, out, out=np.zeros_like(x), where=out > 0) + x[out == 0].sum() / len(ids))
    found = {r.id: r["rank"] for r in G.pagerank(frame, tolerance=1e-10).collect()}
    assert [found[i] for i in ids] == pytest.approx(x.tolist(), abs=1e-8)


def test_payload_and_summary_hold_all_measures(spark, edges):
    rows = {r.id: r for r in G.graph_payload(edges).collect()}
    assert rows[BROKER].degree == 3 and rows[BROKER].betweenness == max(r.betweenness for r in rows.values()) and not rows[BROKER].truncated
    assert [tuple(x) for x in rows[0].links] == [(1, 1), (2, 1), (3, 1), (4, 1), (BROKER, 1)]
    assert G.graph_payload(edges, 5).count() <= 5 and G.graph_payload(edges, 5).first().truncated
    labels = spark.createDataFrame([(i, i // 10) for i in rows], "id long, community long")
    types = spark.createDataFrame([(i, "PERSON" if i % 2 else "PHONE") for i in rows], "id long, type string")
    summary = {r.community: r for r in G.community_summary(labels, edges, types).collect()}
    assert (summary[0].size, summary[0].top_member, summary[0].inside, summary[0].dominant_type) == (5, 0, 10, "PHONE")


def test_long_ways_are_found_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(36)] + [(50, 51, 1.0)], "src long, dst long, weight double")
    assert [r.id for r in G.shortest_path(chain, 0, 36).orderBy("step").collect()] == list(range(37))
    assert G.shortest_path(chain, 0, 51).count() == 0
    far = {r.id: r.hops for r in G.hop_distances(chain, spark.createDataFrame([(0,)], "id long")).collect()}
    assert far == {i: i for i in range(37)}
    assert G.hop_distances(chain, spark.createDataFrame([(0,)], "id long"), 3).count() == 4


def test_betweenness_in_small_groups_equals_dense_matrices(spark, monkeypatch):
    monkeypatch.setattr(G, "CELLS", 40)  # several parts of the arcs and several turns in a group
    draw = random.Random(3)
    pairs = sorted({tuple(sorted(draw.sample(range(14), 2))) for _ in range(22)} | {(20, 21), (21, 22)})
    ids = sorted({i for p in pairs for i in p})
    a = np.zeros((len(ids), len(ids)))
    for x, y in pairs:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    hops, ways, power = np.where(np.eye(len(ids)) > 0, 0, 99), np.eye(len(ids)), np.eye(len(ids))
    for h in range(1, len(ids)):
        power = np.where(hops == 99, power @ a, 0) if h == 1 else np.where(hops == 99, (ways * (hops == h - 1)) @ a, 0)
        ways, hops = ways + power, np.where(power > 0, h, hops)
    n, want = len(ids), {}
    for v in range(n):
        on = [(s, t) for s in range(n) for t in range(n) if len({s, t, v}) == 3 and hops[s, t] < 99 and hops[s, v] + hops[v, t] == hops[s, t]]
        want[ids[v]] = sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in on) / ((n - 1) * (n - 2))
    edges = spark.createDataFrame([(x, y, 1) for x, y in pairs], "src long, dst long, weight long").coalesce(1)
    assert {r.id: r.betweenness for r in G.betweenness(edges).collect()} == pytest.approx(want)


def test_betweenness_in_turns_leaves_no_levels_behind(spark, monkeypatch):
    from ledgerlens.sources.storage import checkpoint_root

    def levels():
        return sum(len(list(Path(checkpoint_root(spark), "ledgerlens").glob(f"betweenness-{kind}-*"))) for kind in ("level", "owed", "part"))

    edges, begun = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (2, 4, 1), (6, 7, 1)], "src long, dst long, weight long").coalesce(1), levels()
    monkeypatch.setattr(G, "ROWS", 14, raising=False)  # three turns
    found = {r.id: r.betweenness for r in G.betweenness(edges).collect()}
    assert found == pytest.approx({1: 0, 2: 0.2, 3: 0, 4: 0, 6: 0, 7: 0}) and levels() == begun


def test_pagerank_takes_few_rounds_on_a_long_chain(spark, monkeypatch):
    rows, kept, stored = [(i, i + 1, 1 + i * i % 7) for i in range(80)], [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: kept.append(name) or stored(df, name))
    found = {r.id: r["rank"] for r in G.pagerank(spark.createDataFrame(rows, "src long, dst long, weight long"), tolerance=1e-12, most_rounds=200).collect()}
    w = np.zeros((81, 81))
    for a, b, weight in rows:
        w[a, b] = w[b, a] = weight
    want = np.linalg.solve(np.eye(81) - 0.85 * w / w.sum(axis=0), np.full(81, 0.15 / 81))
    assert max(abs(found[i] - want[i]) for i in range(81)) < 1e-9
    assert kept.count("pagerank-ranks") <= 10  # 45 rounds at most
