"""Decisions in order against a plain replay."""

from __future__ import annotations

import random

from ledgerlens.operators import governance as V


def test_decisions_equal_a_replay(spark):
    rng = random.Random(17)
    versions = {w: rng.randint(1, 4) for w in range(6)}
    asked = [(rng.randrange(7), rng.randint(0, 9), i, "s", "accepted") for i in range(400)] + [(5, versions[5] + i, 1000 + i, "s", "accepted") for i in range(40)]
    now, want = dict(versions), {}
    for w, expected, i, *_ in sorted(asked, key=lambda r: r[2]):
        if w not in now:
            want[i] = "unknown workspace"
        elif now[w] == expected:
            now[w] += 1
            want[i] = now[w]
        else:
            want[i] = "stale version"
    frame = spark.createDataFrame(asked, "workspace long, expected long, id long, subject string, state string")
    accepted, refused = V.apply_decisions(spark.createDataFrame(list(versions.items()), "workspace long, version long"), frame)
    found = {r.id: r.version for r in accepted.collect()} | {r.id: r.reason for r in refused.collect()}
    assert found == want and max(now.values()) > 8
    assert V.apply_decisions(spark.createDataFrame([], "workspace long, version long"), frame)[0].count() == 0
