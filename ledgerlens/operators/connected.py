"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, stored


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (src, dst); root is the smallest node it reaches.

    Each round hangs a node's neighbours on the smallest of them, by grouped minima
    and joins only.  Ends when every component is a star around its smallest node;
    rounds grow with the logarithm of the nodes.  A node of very many edges meets
    them in one key of the joins, which adaptive execution splits when it is large.
    """
    pairs = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).where("lo < hi").distinct()
    pairs = stored(pairs, f"{name}-edges")
    for _ in range(max_rounds):
        if _are_stars(pairs):
            break
        both = pairs.union(pairs.select("hi", "lo")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("a"), "lo", "hi")
        hung = small.select(F.col("a").alias("lo"), "hi").union(small.select("a", "lo")).where("lo < hi").distinct()
        following = stored(hung, f"{name}-round")
        discard(pairs)
        pairs = following
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(pairs.select("lo", "lo").distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node is either the low end of its edges or the high end of a single one."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.lit(0).alias("high")), F.struct(F.col("hi").alias("node"), F.lit(1).alias("high")))).alias("e"))
    each = ends.groupBy("e.node").agg(F.sum("e.high").alias("high"), F.count("*").alias("n"))
    return each.where("high > 0 and n > 1").agg(F.count("*")).first()[0] == 0
