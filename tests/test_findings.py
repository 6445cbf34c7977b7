"""Findings over all pairs and all decisions, against brute force."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from ledgerlens.operators import evidence as E
from ledgerlens.operators import findings as C
from ledgerlens.plans import QUERIES
from ledgerlens.sources.adapters import calls, holdings

SF = "/root/testdata/sf0.001"


def near(arcs, start, limit):
    """Nodes within limit steps of start."""
    seen = front = {start}
    for _ in range(limit):
        front = {w for v in front for w in arcs[v]} - seen
        seen = seen | front
    return seen


def test_withdrawal_sets_of_all_pairs(spark):
    kind = F.when(F.col("atom").startswith("e"), F.concat(F.lit("calls-"), F.pmod(F.xxhash64("atom"), F.lit(6)).cast("string"))).otherwise(F.substring("atom", 1, 1))
    rows = E.edge_derivations(calls(spark, SF), holdings(spark, SF)).select("src", "dst", "derivation", kind.alias("family")).collect()
    needs = defaultdict(set)
    for r in rows:
        needs[r.src, r.dst, r.derivation].add(r.family)
    families = sorted({f for n in needs.values() for f in n})
    pairs = {tuple(sorted(k[:2])) for k in needs if k[0] != k[1]}

    def parted(gone):
        arcs = defaultdict(set)
        for (a, b, _), n in needs.items():
            if not n & set(gone):
                arcs[a].add(b)
                arcs[b].add(a)
        reach = {a: near(arcs, a, 3) for a, _ in pairs}
        return {(a, b) for a, b in pairs if b not in reach[a]}

    single = {f: parted([f]) for f in families}
    want = {(a, b, f) for f, broken in single.items() for a, b in broken}
    for f, g in combinations(families, 2):
        want |= {(a, b, f"{f}+{g}") for a, b in parted([f, g]) - single[f] - single[g]}
    found = {(r.a, r.b, r.withdrawn) for r in QUERIES["withdrawal_sets"](spark, SF).collect()}
    assert found == want and any(a >= 4 or b >= 30 for a, b, _ in found)


def statuses(arcs, pairs, hubs, limit):
    """Status of each pair; arcs: (src, dst, cost, provisional), both directions."""

    def costs(start, firm):
        best, front = {start: 0}, [start]
        while front:
            v = front.pop(0)
            if firm and best[v] > 0 and v in hubs:
                continue
            for a, b, c, p in arcs:
                if a == v and not (firm and p) and best[v] + c <= limit and best[v] + c < best.get(b, limit + 1):
                    best[b] = best[v] + c
                    front.append(b)
        return best

    out = {}
    for a, b in pairs:
        out[a, b] = "supported" if b in costs(a, True) else "lead" if b in costs(a, False) else "unsupported"
    return out


def test_every_provisional_identity_is_tried(spark):
    """Thirty identities, the one that all findings rest on with the largest ids."""
    both = lambda rows: rows + [(b, a, c, p) for a, b, c, p in rows]
    rows = [(2 * i, 2 * i + 1, 0, True) for i in range(28)] + [(900, 901, 0, True)]  # every identity but the last two
    rows += [(100 + i, 900, 1, False) for i in range(6)] + [(901, 200 + i, 1, False) for i in range(6)]
    rows += [(100, 0, 1, False), (1, 200, 1, False), (101, 300, 1, False), (300, 201, 1, False), (102, 910, 1, False), (910, 911, 0, True), (911, 202, 1, False), (910, 911, 0, False)]
    arcs, hubs = both(rows), {300}
    pairs = [(100 + i, 200 + j) for i in range(6) for j in range(6)]
    base, want = statuses(arcs, pairs, hubs, 2), {}
    for u, v in sorted({(a, b) for a, b, _, p in arcs if p and a < b}):
        for outcome in ("accepted", "rejected"):
            decided = lambda a, b, c: (min(a, b), max(a, b), c) == (u, v, 0)  # noqa: B023, E731
            now = [(a, b, c, p and not decided(a, b, c)) for a, b, c, p in arcs if not (outcome == "rejected" and decided(a, b, c))]
            after = statuses(now, pairs, hubs, 2)
            want[u, v, outcome] = sum(after[p] != base[p] for p in pairs)
    frame = spark.createDataFrame(arcs, "src long, dst long, cost int, provisional boolean")
    asked, stops = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(h,) for h in hubs], "node long")
    effects = C.decision_effects(frame, asked, stops, 2, batch=10)
    assert {(r.src, r.dst, r.outcome): r.changed for r in effects.collect()} == want and len(want) == 60
    first = C.verification_tasks(effects).orderBy("place").first()
    assert (first.src, first.dst) == (900, 901) and first.changes == want[900, 901, "accepted"] + want[900, 901, "rejected"] > 30


def test_decisions_search_no_pair_that_a_reviewed_way_holds(spark, monkeypatch):
    """Round the hub 50 the pair is a lead; the chain of twelve identities lacks one review, and is not walked step by step."""
    rows = [(i, i + 1, 0, i == 6) for i in range(12)] + [(100, 0, 1, False), (12, 200, 1, False), (100, 50, 1, False), (50, 200, 1, False)]
    frame = spark.createDataFrame(rows + [(b, a, c, p) for a, b, c, p in rows], "src long, dst long, cost int, provisional boolean")
    walked = []
    monkeypatch.setattr(C, "distances", lambda *args, **_: walked.append(args))
    effects = C.decision_effects(frame, spark.createDataFrame([(100, 200)], "a long, b long"), spark.createDataFrame([(50,)], "node long"))
    assert {(r.src, r.dst, r.outcome): r.changed for r in effects.collect()} == {(6, 7, "accepted"): 1, (6, 7, "rejected"): 0} and not walked
