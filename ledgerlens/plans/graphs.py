"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.communities import louvain
from ..sources.adapters import calls, contacts, table, transactions
from ..sources.storage import stored
from .registry import ARCS, CALLS, CONTACTS, TXN, query

DEGREE = f"{CONTACTS}, {ARCS}, degree AS (SELECT src AS id, count(*) AS degree FROM arcs GROUP BY 1)"
COMPONENTS = """reach(id, other) AS (SELECT src, src FROM {arcs} UNION SELECT r.id, a.dst FROM reach r JOIN {arcs} a ON r.other = a.src),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"""


@query(f"WITH {TXN} SELECT from_account, to_account, count(*) AS transfers, round(sum(amount), 2) AS total FROM txn GROUP BY 1, 2")
def money_flow(spark, sf_dir):
    return G.money_flow(transactions(spark, sf_dir))


@query(f"""WITH {CALLS}, {CONTACTS}, parts AS (
  SELECT src, dst, 'ASSOCIATES_WITH' AS rel_type, weight::DOUBLE AS weight, src AS seq FROM contacts
  UNION ALL SELECT caller, callee, 'CALLED', count(*)::DOUBLE, min(event_id) FROM calls GROUP BY 1, 2)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight,
  arg_min(rel_type, (rel_type = 'ASSOCIATES_WITH')::BIGINT * 1000000000000 + seq) AS rel_type, count(*) AS parts
FROM parts WHERE src <> dst GROUP BY 1, 2""")  # fmt: skip
def graph_edges(spark, sf_dir):
    relations = contacts(spark, sf_dir).select("src", "dst", F.lit("ASSOCIATES_WITH").alias("rel_type"), "weight", F.col("src").alias("seq"))
    events = calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLED").alias("rel_type"), F.col("event_id").alias("seq"))
    return G.graph_edges(relations, events)


@query(f"WITH {DEGREE} SELECT id, degree, round(degree / ((SELECT count(*) FROM degree) - 1), 6) AS centrality FROM degree")
def degree_centrality(spark, sf_dir):
    return G.degree_centrality(contacts(spark, sf_dir))


@query(f"WITH {DEGREE}, top AS (SELECT id FROM degree ORDER BY degree DESC, id LIMIT 100) SELECT src, dst, weight FROM contacts WHERE src IN (FROM top) AND dst IN (FROM top)")
def graph_top_degree(spark, sf_dir):
    return G.top_degree(contacts(spark, sf_dir), 100)


@query(f"WITH {DEGREE} SELECT id, score, rank FROM (SELECT id, round(degree / ((SELECT count(*) FROM degree) - 1), 6) AS score, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM degree) WHERE rank <= 10")
def key_players(spark, sf_dir):
    return G.key_players(G.degree_centrality(contacts(spark, sf_dir)), "centrality")


@query(f"WITH RECURSIVE {CONTACTS}, {ARCS}, {COMPONENTS.format(arcs='arcs')} SELECT component, count(*) AS size FROM comp GROUP BY 1")
def connected_components(spark, sf_dir):
    return G.component_summary(contacts(spark, sf_dir))


@query(f"""WITH RECURSIVE {CONTACTS}, {ARCS}, kept AS (SELECT * FROM arcs WHERE src % 3 <> 0 AND dst % 3 <> 0), nodes AS (SELECT DISTINCT src AS id FROM arcs WHERE src % 3 <> 0),
{COMPONENTS.format(arcs='kept')} SELECT coalesce(component, n.id) AS component, count(*) AS size FROM nodes n LEFT JOIN comp c ON n.id = c.id GROUP BY 1""")
def fragments(spark, sf_dir):
    """What is left of the contact graph without every third user."""
    edges = contacts(spark, sf_dir)
    return G.fragments(edges, G.vertices(edges).where("id % 3 = 0"))


def _pagerank_sql(rounds: int) -> str:
    step = "(1 - 0.85::DOUBLE) / any_value(n) + 0.85::DOUBLE * sum(p.r * a.weight / o.w)"
    return f"""WITH RECURSIVE {CONTACTS}, {ARCS}, outs AS (SELECT src, sum(weight) AS w FROM arcs GROUP BY 1), n AS (SELECT count(*) AS n FROM outs),
p(i, id, r) AS (SELECT 0, src, 1.0::DOUBLE / n FROM outs, n UNION ALL SELECT any_value(p.i) + 1, a.dst, {step} FROM p JOIN arcs a ON a.src = p.id JOIN outs o ON o.src = p.id, n WHERE p.i < {rounds} GROUP BY a.dst)
SELECT id, round(r, 5) AS rank FROM p WHERE i = {rounds}"""


@query(_pagerank_sql(150))
def pagerank(spark, sf_dir):
    """To convergence: the SQL takes more rounds than that needs."""
    return G.pagerank(contacts(spark, sf_dir), tolerance=1e-12, most_rounds=200).select("id", F.round("rank", 5).alias("rank"))


HOPS = """hops(id, h) AS (SELECT {start}::BIGINT, 0 UNION SELECT a.dst, h + 1 FROM hops JOIN arcs a ON a.src = hops.id WHERE h < 6), dist AS (SELECT id, min(h) AS hops FROM hops GROUP BY 1)"""


@query(f"WITH RECURSIVE {CONTACTS}, {ARCS}, {HOPS.format(start='(SELECT min(src) FROM arcs)')} SELECT id, hops FROM dist")
def hop_distances(spark, sf_dir):
    """Nodes within six hops of the smallest id."""
    edges = contacts(spark, sf_dir)
    return G.hop_distances(edges, G.vertices(edges).agg(F.min("id").alias("id")), 6)


@query(f"""WITH RECURSIVE {CONTACTS}, {ARCS}, ends AS (SELECT min(src) AS s, max(src) AS t FROM arcs), {HOPS.format(start='(SELECT t FROM ends)')},
walk(step, id, h) AS (SELECT 0, s, d.hops FROM ends JOIN dist d ON d.id = s UNION ALL
  SELECT step + 1, (SELECT min(a.dst) FROM arcs a JOIN dist d ON d.id = a.dst WHERE a.src = walk.id AND d.hops = walk.h - 1), h - 1 FROM walk WHERE h > 0)
SELECT step, id FROM walk""")
def shortest_path(spark, sf_dir):
    """From the smallest to the largest id."""
    edges = contacts(spark, sf_dir)
    ends = G.vertices(edges).agg(F.min("id").alias("s"), F.max("id").alias("t")).first()
    return G.shortest_path(edges, ends.s, ends.t, 6)


#: All shortest ways: distances, then the numbers of ways, then what share of each pair's ways a node is on.
BETWEEN = f"""{DEGREE}, near AS (SELECT src, dst FROM arcs), nodes AS (SELECT DISTINCT src AS id FROM near),
walk(s, v, h) AS (SELECT id, id, 0 FROM nodes UNION SELECT w.s, a.dst, w.h + 1 FROM walk w JOIN near a ON a.src = w.v WHERE w.h < 40), hops AS (SELECT s, v, min(h) AS h FROM walk GROUP BY 1, 2),
ways(s, v, h, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM nodes UNION ALL SELECT w.s, a.dst, any_value(w.h) + 1, sum(w.n) FROM ways w JOIN near a ON a.src = w.v JOIN hops d ON d.s = w.s AND d.v = a.dst AND d.h = w.h + 1 GROUP BY w.s, a.dst),
share AS (SELECT x.v AS id, sum(x.n * y.n / z.n) AS b FROM ways x JOIN ways y ON x.v = y.s JOIN ways z ON z.s = x.s AND z.v = y.v AND z.h = x.h + y.h WHERE x.s < y.v AND x.v <> x.s AND x.v <> y.v GROUP BY 1),
between_ AS (SELECT id, coalesce(b, 0) * 2 / greatest(1, (c - 1) * (c - 2)) AS betweenness FROM nodes LEFT JOIN share USING (id), (SELECT count(*) AS c FROM nodes))"""


@query(f"WITH RECURSIVE {BETWEEN} SELECT id, round(betweenness, 6) AS betweenness FROM between_")
def betweenness(spark, sf_dir):
    """Of all users, by searches from each."""
    return G.betweenness(contacts(spark, sf_dir)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"""WITH RECURSIVE {BETWEEN}, best AS (SELECT id AS cand FROM between_ ORDER BY round(betweenness, 6) DESC, id LIMIT 5),
reach(cand, id, other) AS (SELECT cand, id, id FROM best, nodes WHERE id <> cand UNION SELECT r.cand, r.id, a.dst FROM reach r JOIN near a ON a.src = r.other WHERE a.dst <> r.cand),
sizes AS (SELECT cand, m, count(*) AS n FROM (SELECT cand, id, min(other) AS m FROM reach GROUP BY 1, 2) GROUP BY 1, 2),
whole(id, other) AS (SELECT id, id FROM nodes UNION SELECT w.id, a.dst FROM whole w JOIN near a ON a.src = w.other), was AS (SELECT count(*) AS k, max(n) AS m FROM (SELECT m, count(*) AS n FROM (SELECT id, min(other) AS m FROM whole GROUP BY 1) GROUP BY 1))
SELECT cand AS id, any_value(k) AS components_before, count(*) AS components_after, any_value(was.m) AS largest_before, max(n) AS largest_after, round(1 - max(n) / any_value(was.m), 4) AS fragmentation_delta FROM sizes, was GROUP BY 1""")
def removal_impacts(spark, sf_dir):
    """What taking out each of the five nodes of highest betweenness does."""
    edges = contacts(spark, sf_dir)
    return G.removal_impacts(edges, G.key_players(G.betweenness(edges), "betweenness", 5))


@query(f"""WITH RECURSIVE {CONTACTS}, {ARCS}, reach(cut, node) AS (SELECT src, min(dst) FROM arcs GROUP BY 1 UNION SELECT r.cut, a.dst FROM reach r JOIN arcs a ON a.src = r.node WHERE a.dst <> r.cut)
SELECT DISTINCT src AS id FROM arcs WHERE NOT EXISTS (FROM reach r WHERE r.cut = arcs.src AND r.node = arcs.dst)""")
def articulation_points(spark, sf_dir):
    return G.articulation_points(stored(contacts(spark, sf_dir), "contacts"))


@query()
def communities(spark, sf_dir):
    """By modularity; a member's type is its customer's market segment."""
    edges, people = stored(contacts(spark, sf_dir), "contacts"), table(spark, sf_dir, "customer")
    types = people.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    return G.community_summary(louvain(edges), edges, types)


@query(f"WITH RECURSIVE {BETWEEN}, best AS (SELECT id, row_number() OVER (ORDER BY round(betweenness, 6) DESC, id) AS place FROM between_ WHERE betweenness > 0) SELECT id, place FROM best WHERE place <= 5 AND id % 2 = 1")
def centrality_shift(spark, sf_dir):
    """Odd ids that are new among the top five by betweenness, when the even ones were there before."""
    edges = contacts(spark, sf_dir)
    found = G.centrality_shift(G.betweenness(edges), G.vertices(edges).where("id % 2 = 0"))
    return found.select("id", F.col("rank").alias("place"))


@query(f"WITH {CALLS}, linked AS (SELECT DISTINCT caller AS id FROM calls UNION SELECT DISTINCT callee FROM calls) SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (FROM linked)")
def graph_linked_nodes(spark, sf_dir):
    """Customers that take part in some call."""
    c = calls(spark, sf_dir)
    linked = c.select(F.col("caller").alias("id")).union(c.select("callee"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return people.join(linked, "id", "left_semi")


