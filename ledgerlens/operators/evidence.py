"""Evidence over time: who held which number when, what follows, and where accounts of it clash.

Provenance is kept exploded: an edge holds while any of its derivations holds,
and a derivation is the set of statements (atoms) that it needs, one row each.
Withdrawing statements is an anti join, never a recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .connected import components
from .searches import Units

SAME_EVENT_SECONDS = 120
HUB_COUNTERPARTS = 6


def covers(starts: Column, ends: Column, at: Column) -> Column:
    """A half-open interval holds an instant; null bounds are open."""
    return (starts.isNull() | (starts <= at)) & (ends.isNull() | (at < ends))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1.isNull() | e2.isNull() | (s1 < e2)) & (s2.isNull() | e1.isNull() | (s2 < e1))


def temporal_holder_join(calls: DataFrame, holdings: DataFrame) -> DataFrame:
    """Each event with every pair of people who held its two numbers at its instant; nobody calls themselves.

    Equi-joins on the number with the interval test on top, so a hot number is
    split by Spark like any skewed join key.
    """
    h = holdings.select("holding", "person", "identifier", "starts", "ends")
    a = h.toDF("holding_a", "person_a", "caller", "s_a", "e_a")
    b = h.toDF("holding_b", "person_b", "callee", "s_b", "e_b")
    at = F.col("ts")
    left = calls.join(a, "caller").where(covers(F.col("s_a"), F.col("e_a"), at))
    both = left.join(b, "callee").where(covers(F.col("s_b"), F.col("e_b"), at) & (F.col("person_a") != F.col("person_b")))
    return both.select("event_id", "ts", "person_a", "person_b", "holding_a", "holding_b")


def call_edges(calls: DataFrame, holdings: DataFrame) -> DataFrame:
    """Directed edges between people with the number of derivations and the first and last event."""
    j = temporal_holder_join(calls, holdings)
    return j.groupBy(F.col("person_a").alias("src"), F.col("person_b").alias("dst")).agg(
        F.count("*").alias("derivations"), F.countDistinct("event_id").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )


def edge_derivations(calls: DataFrame, holdings: DataFrame) -> DataFrame:
    """(src, dst, derivation, atom): the statements that each derivation of an edge needs."""
    j = temporal_holder_join(calls, holdings)
    atoms = F.array(F.concat(F.lit("e"), "event_id"), "holding_a", "holding_b")
    rows = j.select(F.col("person_a").alias("src"), F.col("person_b").alias("dst"), F.array_sort(F.array_distinct(atoms)).alias("atoms"))
    return rows.select("src", "dst", F.substring(F.sha2(F.array_join("atoms", "\x1f"), 256), 1, 16).alias("derivation"), F.explode("atoms").alias("atom")).distinct()


def restrict_edges(derivations: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Edges that still have a derivation none of whose atoms is withdrawn (atom), with how many."""
    dead = derivations.join(withdrawn, "atom", "left_semi").select("src", "dst", "derivation").distinct()
    alive = derivations.select("src", "dst", "derivation").distinct().join(dead, ["src", "dst", "derivation"], "left_anti")
    return alive.groupBy("src", "dst").agg(F.count("*").alias("derivations"))


def shared_identifiers(holdings: DataFrame) -> DataFrame:
    """People who held one number at overlapping times."""
    h = holdings.select("holding", "person", "identifier", "starts", "ends")
    a, b = h.toDF("holding_a", "person_a", "identifier", "s_a", "e_a"), h.toDF("holding_b", "person_b", "identifier", "s_b", "e_b")
    j = a.join(b, "identifier").where((F.col("person_a") < F.col("person_b")) & overlaps(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")))
    return j.select("identifier", "person_a", "person_b", "holding_a", "holding_b")


def conflicts(calls: DataFrame, holdings: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Events whose caller's number was held by people of more than one identity cluster; clusters: (person, cluster)."""
    h = holdings.select("person", F.col("identifier").alias("caller"), "starts", "ends")
    held = calls.join(h, "caller").where(covers(F.col("starts"), F.col("ends"), F.col("ts")))
    if clusters is not None:
        held = held.join(clusters, "person", "left")
    cluster = F.coalesce("cluster", "person") if clusters is not None else F.col("person")
    found = held.select("event_id", "caller", "person", cluster.alias("cluster")).groupBy("event_id", F.col("caller").alias("identifier"))
    return found.agg(F.countDistinct("cluster").alias("holders"), F.min("person").alias("least_person"), F.max("person").alias("most_person")).where("holders > 1")


def identity_clusters(same_as: DataFrame) -> DataFrame:
    """(person, cluster) of accepted identity links (a, b); a cluster is named by its smallest person."""
    return components(same_as.select(F.col("a").alias("src"), F.col("b").alias("dst")), "identity").toDF("person", "cluster")


def hubs(edges: DataFrame, clusters: DataFrame | None = None, least: int = HUB_COUNTERPARTS) -> DataFrame:
    """People (src or dst of an edge) with least or more different counterpart clusters."""
    both = edges.select(F.col("src").alias("person"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    if clusters is not None:
        both = both.join(clusters.toDF("other", "cluster"), "other", "left").withColumn("other", F.coalesce("cluster", "other"))
    return both.groupBy("person").agg(F.countDistinct("other").alias("counterparts")).where(F.col("counterparts") >= least)


def same_event_links(calls: DataFrame, seconds: int = SAME_EVENT_SECONDS) -> DataFrame:
    """Pairs of records of one call: same numbers, at most seconds apart; the lower id is the origin.

    The band is cut into buckets of its own width and a row looks into its bucket
    and the next one, so a busy pair is compared with near instants only.
    """
    s = calls.select("event_id", "caller", "callee", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    width = seconds * 1_000_000
    s = s.withColumn("bucket", F.expr(f"us div {width}"))
    a = s.toDF("id_a", "caller", "callee", "us_a", "bucket").withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1, F.col("bucket") - 1)))
    b = s.toDF("id_b", "caller", "callee", "us_b", "bucket")
    j = a.join(b, ["caller", "callee", "bucket"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("us_a") - F.col("us_b")) <= width))
    return j.select(F.col("id_b").alias("derivative"), F.col("id_a").alias("origin"), "caller", "callee")


def one_link_each(links: DataFrame) -> DataFrame:
    """One link per derivative: declared before near-verbatim before same-event, then the smallest origin.

    links: derivative, origin, basis.
    """
    rank = F.when(F.col("basis") == "declared", 0).when(F.col("basis") == "near_verbatim", 1).otherwise(2)
    order = Window.partitionBy("derivative").orderBy(rank, "origin")
    return links.withColumn("n", F.row_number().over(order)).where("n = 1").select("derivative", "origin", "basis")


def lineage_roots(links: DataFrame) -> DataFrame:
    """(item, root) by pointer doubling over (derivative, origin), one link per derivative.

    Items whose origins run in a circle have the smallest item connected to them as root.
    """
    at = stored(links.select(F.col("derivative").alias("item"), F.col("origin").alias("root")), "lineage")
    for _ in range(at.count().bit_length() + 1):  # each round doubles how far a pointer reaches
        up = at.select(F.col("item").alias("mid"), F.col("root").alias("far"))
        moved = stored(at.join(up, at.root == up.mid, "left").select("item", "root", F.coalesce("far", "root").alias("next")), "lineage")
        at = moved.select("item", F.col("next").alias("root"))
        if moved.where("next <> root").isEmpty():
            break
    turning = links.select(F.col("derivative").alias("root")).distinct()
    circles = components(links.select(F.col("derivative").alias("src"), F.col("origin").alias("dst")), "circles").select(F.col("node").alias("item"), F.col("root").alias("least"))
    settled = at.join(turning, "root", "left_anti").select("item", "root")
    return settled.unionByName(at.join(turning, "root", "left_semi").join(circles, "item").select("item", F.col("least").alias("root")))


def active_assertions(assertions: DataFrame, roots: DataFrame, states: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Statements (key, artifact) in force: neither they nor their origin disputed or rejected, their family not withdrawn.

    states: (key, state); withdrawn: (family).  A statement's family is its origin's artifact.
    """
    bad = states.where(F.col("state").isin("disputed", "rejected")).select("key")
    named = assertions.join(roots, assertions.key == roots.item, "left").select(assertions["*"], F.coalesce("root", "key").alias("origin_key"))
    family = assertions.select(F.col("key").alias("origin_key"), F.col("artifact").alias("family"))
    out = named.join(family, "origin_key", "left").withColumn("family", F.coalesce("family", "artifact"))
    out = out.join(bad, "key", "left_anti").join(bad.withColumnRenamed("key", "origin_key"), "origin_key", "left_anti")
    return out.join(withdrawn, "family", "left_anti")


def firm_distance(edges: DataFrame, start: DataFrame, limit: int = 3) -> DataFrame:
    """(node, cost) of nodes within limit: identity steps (cost 0) are free, all others cost 1.

    edges: src, dst, cost (0 or 1), both directions given.  start: node.
    """
    return Units(edges).costs(start, [], limit)


def latest(decisions: DataFrame, key: list[str]) -> DataFrame:
    """The newest decision of each key by (version, id)."""
    others = [c for c in decisions.columns if c not in key]
    return decisions.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("version", "id")).alias("d")).select(*key, "d.*")


def scenario_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change) of two edge sets with derivation counts: added, removed, weakened or strengthened."""
    b, a = before.select("src", "dst", F.col("derivations").alias("n_before")), after.select("src", "dst", F.col("derivations").alias("n_after"))
    j = b.join(a, ["src", "dst"], "full_outer")
    change = F.when(F.col("n_before").isNull(), "added").when(F.col("n_after").isNull(), "removed").when(F.col("n_after") < F.col("n_before"), "weakened").when(F.col("n_after") > F.col("n_before"), "strengthened")
    return j.withColumn("change", change).where("change is not null").select("src", "dst", "change", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
