from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.operators.ranks import placed


def test_places_are_those_of_the_whole_order(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(5)
    found = placed(frame, [F.col("a"), F.desc("b")]).collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r.place for r in found) == list(range(1, 3001))
    assert placed(frame.where("false"), [F.col("a")]).count() == 0
