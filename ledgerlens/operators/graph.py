"""Graph projection and analytics over vertex and edge tables.

An undirected edge is one row (src < dst, weight).  All measures are joins and
grouped sums: searches from many sources carry the source in their keys, so
neither a graph nor a component is ever in one task or in the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, stored
from .connected import components

MAX_GRAPH_NODES = 500
#: Hops after which what has been reached is stored as one table.
SHORT = 10
EVIDENCE = 8
#: Rows, arcs or sums that a group of searches has at once.
CELLS = 1_000_000
#: Rows (source, node) that searches from many sources have stored at once, about.
ROWS = 20_000_000


def money_flow(txn: DataFrame) -> DataFrame:
    """Transfers and total of each directed pair of accounts."""
    return txn.groupBy("from_account", "to_account").agg(F.count("*").alias("transfers"), F.round(F.sum("amount"), 2).alias("total"))


def graph_edges(relations: DataFrame, events: DataFrame) -> DataFrame:
    """One undirected edge for each pair that a relation or an event joins.

    relations: src, dst, rel_type, weight, seq.  events: src, dst, rel_type, seq.
    Events count once for each directed pair and are added to the relations'
    weights.  The label is the earliest one that is not ASSOCIATES_WITH, else
    that.  Self loops go.
    """
    counted = events.groupBy("src", "dst", "rel_type").agg(F.count("*").cast("double").alias("weight"), F.min("seq").alias("seq"))
    both = relations.select("src", "dst", "rel_type", F.col("weight").cast("double"), "seq").unionByName(counted.select("src", "dst", "rel_type", "weight", "seq"))
    both = both.where("src <> dst")
    order = F.struct((F.col("rel_type") == "ASSOCIATES_WITH").cast("int"), F.col("seq"), F.col("rel_type"))
    return both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"), F.min_by("rel_type", order).alias("rel_type"), F.count("*").alias("parts"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    n = vertices(edges).count()
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).withColumn("centrality", F.round(F.col("degree") / max(1, n - 1), 6))


def top_degree(edges: DataFrame, nodes: int = MAX_GRAPH_NODES) -> DataFrame:
    """Edges among the nodes of highest degree, smallest id first on ties."""
    kept = degree_centrality(edges).orderBy(F.desc("degree"), "id").limit(nodes).select("id")
    out = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def component_summary(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("component"), "size")


def fragments(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Components left when the removed nodes (id) and their edges are taken out; lone nodes count."""
    left = edges.join(removed, edges.src == removed.id, "left_anti").join(removed, F.col("dst") == removed.id, "left_anti")
    nodes = vertices(edges).join(removed, "id", "left_anti")
    found = components(left)
    named = nodes.join(found, nodes.id == found.node, "left").select("id", F.coalesce("root", "id").alias("component"))
    return named.groupBy("component").agg(F.count("*").alias("size"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """(id, rank): weighted PageRank, until a plain round would move less than nodes * tolerance of the mass in all.

    The mass of nodes whose edges weigh nothing is dealt evenly to all.  Edges go both
    ways, so the round's linear part has real eigenvalues within the damping, and
    Chebyshev's weights for that range (each round also takes the ranks of the round
    before last) need about a third of the rounds.  Arcs are dealt by their source once
    and stay where they are; a row of each node to itself carries its own ranks on, so
    a round reads the ranks once.  Convergence is looked at every fifth round, when
    the ranks are stored.
    """
    both = stored(both_ways(edges), "pagerank-both")
    out = stored(both.groupBy("src").agg(F.sum("weight").alias("out_weight")), "pagerank-out")
    arcs = both.join(out, "src").where("out_weight > 0").select("src", "dst", (F.col("weight") / F.col("out_weight")).alias("share"))
    arcs = stored(arcs.unionByName(out.select("src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("share"))), "pagerank-arcs")
    arcs = arcs.repartition("src").persist()
    nodes = stored(out.select(F.col("src").alias("id"), (F.col("out_weight") <= 0).alias("dangling")), "pagerank-nodes")
    n, loose = nodes.count(), not nodes.where("dangling").isEmpty()
    start = F.lit(1.0 / max(1, n))
    ranks = stored(nodes.select("id", start.alias("rank"), start.alias("last")), "pagerank-ranks")
    omega = 1.0
    for begun in range(0, most_rounds, 5):
        now = ranks
        for turn in range(begun, min(begun + 5, most_rounds)):
            omega = 1.0 if turn == 0 else 1 / (1 - damping * damping / 2) if turn == 1 else 1 / (1 - damping * damping * omega / 4)
            lost = (now.join(nodes.where("dangling"), "id").agg(F.sum("rank")).first()[0] or 0.0) if loose else 0.0
            own = lambda c: F.max(F.when(F.col("share").isNull(), F.col(c))).alias(c)
            moved = arcs.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"), own("rank"), own("last"))
            plain = F.lit((1 - damping + damping * lost) / max(1, n)) + F.coalesce("got", F.lit(0.0)) * damping
            now = moved.select("id", (F.lit(omega) * (plain - F.col("last")) + F.col("last")).alias("rank"), F.col("rank").alias("last"), F.abs(plain - F.col("rank")).alias("moved"))
        before, ranks = ranks, stored(now, "pagerank-ranks")
        discard(before)
        error = ranks.agg(F.sum("moved")).first()[0] or 0.0
        if error < n * tolerance:
            break
    arcs.unpersist()
    return ranks.select("id", "rank")


def hop_distances(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, hops) of all nodes that the start nodes (id) reach, stored: one frontier join a hop, to the end or to a limit that the caller sets."""
    arcs = both_ways(edges).select("src", "dst").distinct()
    reached = stored(start.select("id", F.lit(0).alias("hops")).distinct(), "hops")
    frontier, hop = reached, 0
    while limit is None or hop < limit:
        hop += 1
        following = frontier.join(arcs, frontier.id == arcs.src).select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti")
        frontier = stored(following.select("id", F.lit(hop).alias("hops")), "hops")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
        if hop % SHORT == 0:  # one table for all hops so far, so that the plan of a long way stays small
            reached = stored(reached, "hops")
    return reached


def shortest_path(edges: DataFrame, source: int, target: int, limit: int | None = None) -> DataFrame:
    """(step, id) of a path with the fewest hops; on ties each step takes the smallest id.  No rows without a path.

    The search from the target keeps each node's way on (the least neighbour one
    hop nearer), so the path is read off the reached nodes without further searches.
    """
    spark = edges.sparkSession
    back = stored(hop_distances(edges, spark.createDataFrame([(target,)], "id long"), limit), "path-hops")
    arcs = both_ways(edges).select("src", "dst").distinct()
    at = back.where(F.col("id") == source).first()
    if at is None:
        return spark.createDataFrame([], "step int, id long")
    nearer = back.select(F.col("id").alias("dst"), F.col("hops").alias("less"))
    ways = back.where(F.col("hops") <= at.hops).join(arcs, back.id == arcs.src).join(nearer, "dst").where("less = hops - 1")
    following = stored(ways.groupBy("id", "hops").agg(F.min("dst").alias("following")), "path-ways")
    path = spark.createDataFrame([(0, source)], "step int, id long")
    here = path
    for step in range(1, at.hops + 1):
        here = here.join(following, "id").select(F.lit(step).alias("step"), F.col("following").alias("id"))
        path = path.unionByName(here)
        if step % SHORT == 0:
            path = stored(path, "path-steps")
            here = path.where(F.col("step") == step)
    return path


def _spread(rows: DataFrame, arcs: DataFrame, rows_: int, arcs_: int) -> DataFrame:
    """(source, node, value): what reaches each node over all arcs (src, dst) from rows (source, node, value > 0), summed.

    A block of sources meets a part of the arcs' ends in a group, which adds up all
    that this part gets: no row a source and arc is shuffled.  A group has about
    CELLS rows and arcs at most; rows_ and arcs_ say how many there may be in all.
    """
    blocks, parts = max(4, -(-rows_ // CELLS)), max(2, -(-arcs_ // CELLS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("source", "node", "value", F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block"), every(parts).alias("part"))
    right = arcs.select("src", "dst", every(blocks).alias("block"), F.pmod(F.xxhash64("dst"), F.lit(parts)).alias("part"))

    def run(mine: pa.Table, ends: pa.Table) -> pa.Table:
        sources, s = np.unique(mine["source"].to_numpy(), return_inverse=True)
        targets, t = np.unique(ends["dst"].to_numpy(), return_inverse=True)
        u, node, value = ends["src"].to_numpy(), mine["node"].to_numpy(), mine["value"].to_numpy()
        order = np.argsort(u, kind="stable")
        u, t = u[order], t[order]
        first = np.searchsorted(u, node, "left")
        counts = np.searchsorted(u, node, "right") - first
        done, total, at = np.cumsum(counts), np.zeros(len(sources) * len(targets)), 0
        while at < len(node):
            stop = max(at + 1, int(np.searchsorted(done, done[at] - counts[at] + CELLS, "right")))
            n = counts[at:stop]
            arc = np.repeat(first[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(total, np.repeat(s[at:stop] * len(targets), n) + t[arc], np.repeat(value[at:stop], n))
            at = stop
        cell = np.flatnonzero(total)
        out = (sources[cell // max(1, len(targets))], targets[cell % max(1, len(targets))], total[cell])
        return pa.table({"source": pa.array(out[0], pa.int64()), "node": pa.array(out[1], pa.int64()), "value": pa.array(out[2], pa.float64())})

    both = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return both.applyInArrow(run, "source long, node long, value double")


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness): exact unweighted betweenness, normalised for undirected graphs.

    Sources are searched from together, level by level, as many at a time as have
    about ROWS rows (source, node) in all: rows hold the number of shortest ways.
    Then the levels are gone back through, and each node gets its share of what the
    next level's nodes are owed.  Levels are deleted once they are gone through, so
    what is stored does not grow with the square of the nodes; the work does, as it
    is that of a search from every node: truncate large graphs first.
    """
    arcs = stored(both_ways(edges).where("src <> dst").select("src", "dst").distinct(), "betweenness-arcs")
    arcs = arcs.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    nodes = stored(arcs.select("src").distinct(), "betweenness-nodes")
    n, m = nodes.count(), arcs.count()
    turns = max(1, -(-n * n // ROWS))
    score = nodes.select(F.col("src").alias("id"), F.lit(0.0).alias("part"))
    for turn in range(turns):
        sources = nodes.where(F.pmod(F.xxhash64(F.lit("turn"), "src"), F.lit(turns)) == turn)
        before = score
        score = score.unionByName(_owed(sources, arcs, -(-n * n // turns), m))
        if turns > 1:  # one table for all turns so far
            score = stored(score.groupBy("id").agg(F.sum("part").alias("part")), "betweenness-score")
            if turn:
                discard(before)
    return score.groupBy("id").agg((F.sum("part") / max(1, (n - 1) * (n - 2))).alias("betweenness"))


def _owed(sources: DataFrame, arcs: DataFrame, rows_: int, arcs_: int) -> DataFrame:
    """(id, part), stored: what searches from the sources (src) owe to the nodes they pass, a row a node and level; rows_: about how many (source, node) there are."""
    levels = [stored(sources.select(F.col("src").alias("source"), F.col("src").alias("node"), F.lit(1.0).alias("ways")), "betweenness-level")]
    before = None
    while True:
        last = levels[-1]
        stepped = _spread(last.withColumnRenamed("ways", "value"), arcs, rows_, arcs_).withColumnRenamed("value", "ways")
        # A neighbour of a level is in it, in the one before, or in the next.
        known = last if before is None else last.unionByName(before)
        following = stored(stepped.join(known.select("source", "node"), ["source", "node"], "left_anti"), "betweenness-level")
        if following.isEmpty():
            discard(following)
            break
        before = last
        levels.append(following)
    discard(levels[0])
    parts, owed = [], None
    for level in reversed(levels[1:]):
        if owed is None:
            now = level.withColumn("owed", F.lit(0.0))
        else:
            later = owed.select("source", "node", ((F.col("owed") + 1) / F.col("ways")).alias("value"))
            given = _spread(later, arcs, rows_, arcs_).withColumnRenamed("value", "each")
            now = level.join(given, ["source", "node"], "left").withColumn("owed", F.coalesce(F.col("each") * F.col("ways"), F.lit(0.0))).drop("each")
        gone, owed = owed, stored(now, "betweenness-owed")
        discard(level, *([] if gone is None else [gone]))
        parts.append(owed.groupBy(F.col("node").alias("id")).agg(F.sum("owed").alias("part")))
        parts[-1] = stored(parts[-1], "betweenness-part")
    if owed is not None:
        discard(owed)
    out = sources.sparkSession.createDataFrame([], "id long, part double")
    for part in parts:
        out = out.unionByName(part)
    found = stored(out, "betweenness-parts")
    discard(*parts)
    return found


def key_players(scores: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The top rows by score, smallest id first on ties, with their ranks."""
    best = scores.select("id", F.round(column, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def removal_impacts(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each of up to 25 candidates (id): components and largest component before and after its removal, and the share lost.

    One job for all candidates: edges and nodes are keyed by (candidate, node), so
    the components of every what-if are found together.
    """
    spark = edges.sparkSession
    listed = [r.id for r in candidates.select("id").distinct().orderBy("id").limit(26).collect()]
    if len(listed) > 25:
        raise ValueError("at most 25 candidates")
    if not listed:
        return spark.createDataFrame([], "id long, components_before long, components_after long, largest_before long, largest_after long, fragmentation_delta double")
    before = components(edges).groupBy("root").agg(F.count("*").alias("size")).agg(F.count("*").alias("n"), F.max("size").alias("largest")).first()
    cases, named = F.explode(F.array(*[F.lit(int(c)).cast("long") for c in listed])).alias("case"), lambda c: F.concat_ws(":", "case", c)
    e = edges.select("src", "dst", cases).where("src <> case and dst <> case").select(named("src").alias("src"), named("dst").alias("dst"))
    left = vertices(edges).select("id", cases).where("id <> case").select("case", named("id").alias("node"))
    sizes = left.join(components(e, "removal"), "node", "left").groupBy("case", F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("size"))
    after = sizes.groupBy(F.col("case").alias("id")).agg(F.count("*").alias("components_after"), F.max("size").alias("largest_after"))
    return after.select(
        "id", F.lit(before.n).cast("long").alias("components_before"), "components_after", F.lit(before.largest).cast("long").alias("largest_before"), "largest_after",
        F.round(1 - F.col("largest_after") / F.lit(before.largest), 4).alias("fragmentation_delta"),
    )


def spanning_tree(edges: DataFrame) -> list[DataFrame]:
    """Levels of a breadth-first forest, stored: (node, parent, root), the smallest parent on ties; level 0 holds the roots."""
    arcs = stored(both_ways(edges).where("src <> dst").select("src", "dst").distinct(), "tree-arcs")
    roots = components(edges, "tree")
    levels = [stored(roots.where("node = root").select("node", F.col("node").alias("parent"), "root"), "tree-level")]
    before = None
    while True:
        last = levels[-1]
        stepped = last.join(arcs, last.node == arcs.src).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.min("root").alias("root"))
        known = last.select("node") if before is None else last.select("node").union(before.select("node"))
        following = stored(stepped.join(known, "node", "left_anti"), "tree-level")
        if following.isEmpty():
            return levels
        before = last
        levels.append(following)


def articulation_points(edges: DataFrame) -> DataFrame:
    """(id): nodes whose removal splits their component, which are those on edges of several biconnected blocks.

    By a spanning tree whose edges are named by their lower nodes: nodes are
    numbered in preorder, subtrees learn the least and greatest number that their
    other edges lead to, and tree edges are joined where a cycle holds both.  The
    components of that relation are the blocks.  Every step is a join or a grouped
    minimum, over levels of the tree or over all edges.
    """
    levels = spanning_tree(edges)
    # Sizes of subtrees, from the lowest level up.
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            below = sized[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
            level = level.join(below, "node", "left").withColumn("size", F.coalesce("below", F.lit(0)) + 1).drop("below")
        else:
            level = level.withColumn("size", F.lit(1).cast("long"))
        sized.append(stored(level, "cuts-sizes"))
    sized.reverse()
    # Preorder numbers within a root's tree, from the roots down.
    numbered = [sized[0].withColumn("number", F.lit(0).cast("long"))]
    siblings = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    for level in sized[1:]:
        above = numbered[-1].select(F.col("node").alias("parent"), F.col("number").alias("above"))
        row = level.withColumn("earlier", F.coalesce(F.sum("size").over(siblings), F.lit(0))).join(above, "parent")
        numbered.append(stored(row.withColumn("number", F.col("above") + 1 + F.col("earlier")).select("node", "parent", "root", "size", "number"), "cuts-numbers"))
    tree = numbered[0].select("node", "parent", "root", "size", "number")
    for level in numbered[1:]:
        tree = tree.unionByName(level)
    tree = stored(tree, "cuts-tree")
    ends = both_ways(edges).where("src <> dst").select("src", "dst").distinct()
    ends = ends.join(tree.select(F.col("node").alias("src"), F.col("parent").alias("p1"), F.col("number").alias("n1"), F.col("size").alias("s1")), "src")
    ends = ends.join(tree.select(F.col("node").alias("dst"), F.col("parent").alias("p2"), F.col("number").alias("n2"), F.col("size").alias("s2")), "dst")
    other = stored(ends.where("p1 <> dst and p2 <> src"), "cuts-other")
    reach = other.groupBy(F.col("src").alias("node")).agg(F.min("n2").alias("least"), F.max("n2").alias("most"))
    # The least and greatest number that a subtree's other edges lead to, from the lowest level up.
    spans, below = [], None
    for level in reversed(numbered):
        row = level.select("node", "parent", "number", "size").join(reach, "node", "left")
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            row = row.join(under, "node", "left")
        else:
            row = row.withColumns({"l": F.lit(None).cast("long"), "h": F.lit(None).cast("long")})
        below = stored(row.select("node", "parent", F.least("number", "least", "l").alias("low"), F.greatest("number", "most", "h").alias("high")), "cuts-spans")
        spans.append(below)
    span = spans[0]
    for level in spans[1:]:
        span = span.unionByName(level)
    # Edges are named by their lower nodes: an edge and its parent's share a block if the subtree leads out of the parent's.
    above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("number").alias("pn"), F.col("size").alias("ps"))
    climbing = span.where("node <> parent").join(above, "parent").where("parent <> grand and (low < pn or high >= pn + ps)").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    crossing = other.where("n1 + s1 <= n2").select("src", "dst")
    blocks = components(climbing.unionByName(crossing), "cuts")
    low = tree.where("node <> parent").select("node", "parent").join(blocks, "node", "left").select("node", "parent", F.coalesce("root", "node").alias("block"))
    on = low.select(F.col("node").alias("id"), "block").unionByName(low.select(F.col("parent").alias("id"), "block"))
    return on.groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("id")


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): synchronous weighted label propagation, damped by parity; ties take the smaller label.

    In even rounds nodes of even hash move, in odd rounds the others, so that
    neighbours do not swap labels for ever.
    """
    arcs = both_ways(edges)
    labels = stored(vertices(edges).select("id", F.col("id").alias("community")), "communities")
    for i in range(rounds):
        votes = arcs.join(labels, arcs.dst == labels.id).groupBy("src", "community").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("src").agg(F.max_by("community", F.struct("votes", -F.col("community"))).alias("best"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        before = labels
        labels = stored(labels.join(best, labels.id == best.src).select("id", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community")), "communities")
        discard(before)
    return labels


def community_summary(labels: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Communities by size: members in order, weight inside, the member of highest degree, and with types (id, type) the commonest type.

    On ties the smallest id leads, and the type that is first in order; communities of one size are in order of their names.
    """
    degree = degree_centrality(edges).select("id", "degree")
    a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    sizes = labels.join(degree, "id").groupBy("community").agg(F.count("*").alias("size"), F.max_by("id", F.struct("degree", -F.col("id"))).alias("top_member"), F.array_sort(F.collect_list("id")).alias("members"))
    found = sizes.join(inside, "community", "left").select("community", "size", "top_member", F.coalesce("inside", F.lit(0)).alias("inside"), "members")
    found = found if types is None else found.join(dominant_type(labels, types), "community", "left")
    return found.orderBy(F.desc("size"), "community")


def dominant_type(labels: DataFrame, types: DataFrame) -> DataFrame:
    """(community, dominant_type): the commonest type among a community's members; on ties the first in order."""
    counted = labels.join(types, "id").groupBy("community", "type").agg(F.count("*").alias("n"))
    most = counted.groupBy("community").agg(F.max("n").alias("n"))
    return counted.join(most, ["community", "n"]).groupBy("community").agg(F.min("type").alias("dominant_type"))


def modularity(labels: DataFrame, edges: DataFrame) -> float:
    """Weighted modularity of a labelling."""
    total = edges.agg(F.sum("weight")).first()[0]
    degree = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").agg(F.sum("weight")).first()[0] or 0
    squares = labels.join(degree, "id").groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - squares / (4.0 * total * total)


def centrality_shift(current: DataFrame, previous: DataFrame, top: int = 5) -> DataFrame:
    """Nodes that entered the top by score since the previous top (id); scores of 0 never enter."""
    best = key_players(current.where("betweenness > 0"), "betweenness", top)
    return best.join(previous, "id", "left_anti")


def eigenvector(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, eigenvector): unit-length leading eigenvector of the largest component (smallest id on ties), 0 elsewhere.

    Power iteration on the unweighted adjacency plus the identity, which has the
    same leading vector and settles on bipartite graphs too.
    """
    found = stored(components(edges, "eigen"), "eigen-components")
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "root").limit(1).select("root")
    members = stored(found.join(F.broadcast(largest), "root", "left_semi").select(F.col("node").alias("id")), "eigen-members")
    arcs = both_ways(edges).select("src", "dst").distinct().join(members.withColumnRenamed("id", "src"), "src", "left_semi")
    arcs = stored(arcs.unionByName(members.select(F.col("id").alias("src"), F.col("id").alias("dst"))), "eigen-arcs")
    arcs = arcs.repartition("src").persist()  # dealt once; a round shuffles sums only
    x = members.withColumn("x", F.lit(1.0))
    for i in range(rounds):
        y = arcs.join(x, arcs.src == x.id).groupBy("dst").agg(F.sum("x").alias("y"))
        if i % 5 == 4 or i == rounds - 1:
            y = stored(y, "eigen-vector")
            norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
            x = y.select(F.col("dst").alias("id"), (F.col("y") / norm).alias("x"))
        else:
            x = y.select(F.col("dst").alias("id"), F.col("y").alias("x"))
    arcs.unpersist()
    return vertices(edges).join(x, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("eigenvector"))


def graph_payload(edges: DataFrame, nodes: int = MAX_GRAPH_NODES) -> DataFrame:
    """(id, degree, betweenness, pagerank, eigenvector, community, links, truncated): what a view of the graph needs of each node.

    links are the node's edges to larger ids, (dst, weight) in order.  Only the best
    connected nodes are shown; truncated tells that there are others.
    """
    kept = stored(top_degree(edges, nodes), "payload-edges")
    total = vertices(edges).count()
    links = kept.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("links"))
    found = degree_centrality(kept).select("id", "degree")
    for measure in (
        betweenness(kept).select("id", F.round("betweenness", 6).alias("betweenness")), pagerank(kept).select("id", F.round("rank", 6).alias("pagerank")),
        eigenvector(kept).select("id", F.round("eigenvector", 6).alias("eigenvector")), communities(kept),
    ):
        found = found.join(measure, "id")
    return found.join(links, "id", "left").select("id", "degree", "betweenness", "pagerank", "eigenvector", "community", F.coalesce("links", F.array()).alias("links"), F.lit(total > nodes).alias("truncated"))
