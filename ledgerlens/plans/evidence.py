"""Evidence, linking, governance and vision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import governance as V
from ..operators import vision as N
from ..sources.adapters import calls, contacts, holdings, table, transactions
from ..sources.records import with_owners
from .registry import CALLS, CONTACTS, HOLDINGS, TXN, query

JOIN = """j AS (SELECT c.event_id, c.ts, a.person AS person_a, b.person AS person_b, a.holding AS holding_a, b.holding AS holding_b FROM calls c
  JOIN holdings a ON a.identifier = c.caller AND (a.starts IS NULL OR a.starts <= c.ts) AND (a.ends IS NULL OR c.ts < a.ends)
  JOIN holdings b ON b.identifier = c.callee AND (b.starts IS NULL OR b.starts <= c.ts) AND (b.ends IS NULL OR c.ts < b.ends) WHERE a.person <> b.person)"""
EDGES = "edges AS (SELECT person_a AS src, person_b AS dst, count(*) AS derivations FROM j GROUP BY 1, 2)"


def _pair(spark, sf_dir):
    return calls(spark, sf_dir), holdings(spark, sf_dir)


@query(f"WITH {CALLS}, {HOLDINGS}, {JOIN} SELECT * FROM j")
def temporal_holder_join(spark, sf_dir):
    return E.temporal_holder_join(*_pair(spark, sf_dir))


@query(f"WITH {CALLS}, {HOLDINGS}, {JOIN} SELECT person_a AS src, person_b AS dst, count(*) AS derivations, count(DISTINCT event_id) AS events, min(ts) AS first_at, max(ts) AS last_at FROM j GROUP BY 1, 2")
def call_edges(spark, sf_dir):
    return E.call_edges(*_pair(spark, sf_dir))


@query(f"""WITH {CALLS}, {HOLDINGS}, {JOIN}, d AS (SELECT person_a AS src, person_b AS dst, list_sort(list_distinct(['e' || event_id, holding_a, holding_b])) AS atoms FROM j)
SELECT DISTINCT src, dst, substr(sha256(array_to_string(atoms, chr(31))), 1, 16) AS derivation, unnest(atoms) AS atom FROM d""")
def edge_derivations(spark, sf_dir):
    return E.edge_derivations(*_pair(spark, sf_dir))


@query(f"WITH {CALLS}, {HOLDINGS}, {JOIN} SELECT person_a AS src, person_b AS dst, count(DISTINCT (event_id, holding_a, holding_b)) AS derivations FROM j WHERE holding_a NOT LIKE 'C%' AND holding_b NOT LIKE 'C%' GROUP BY 1, 2")
def restrict_edges(spark, sf_dir):
    """Edges that stand without any claim."""
    d = E.edge_derivations(*_pair(spark, sf_dir))
    return E.restrict_edges(d, d.where("atom like 'C%'").select("atom").distinct())


@query(f"""WITH {CALLS}, {HOLDINGS}, {JOIN}, {EDGES}, firm AS (SELECT person_a AS src, person_b AS dst, count(*) AS n FROM j WHERE holding_a NOT LIKE 'C%' AND holding_b NOT LIKE 'C%' GROUP BY 1, 2)
SELECT e.src, e.dst, CASE WHEN f.n IS NULL THEN 'removed' ELSE 'weakened' END AS change, derivations AS n_before, coalesce(f.n, 0)::BIGINT AS n_after FROM edges e LEFT JOIN firm f USING (src, dst) WHERE f.n IS NULL OR f.n < derivations""")
def scenario_compare(spark, sf_dir):
    """What withdrawing all claims does to the edges."""
    d = E.edge_derivations(*_pair(spark, sf_dir))
    none = d.select("atom").where("false")
    return E.scenario_compare(E.restrict_edges(d, none), E.restrict_edges(d, d.where("atom like 'C%'").select("atom").distinct()))


@query(f"""WITH {HOLDINGS} SELECT a.identifier, a.person AS person_a, b.person AS person_b, a.holding AS holding_a, b.holding AS holding_b FROM holdings a JOIN holdings b ON a.identifier = b.identifier AND a.person < b.person
WHERE (a.starts IS NULL OR b.ends IS NULL OR a.starts < b.ends) AND (b.starts IS NULL OR a.ends IS NULL OR b.starts < a.ends)""")
def shared_identifiers(spark, sf_dir):
    return E.shared_identifiers(holdings(spark, sf_dir))


@query(f"""WITH {CALLS}, {HOLDINGS} SELECT event_id, caller AS identifier, count(DISTINCT person) AS holders, min(person) AS least_person, max(person) AS most_person FROM calls c
JOIN holdings a ON a.identifier = c.caller AND (a.starts IS NULL OR a.starts <= c.ts) AND (a.ends IS NULL OR c.ts < a.ends) GROUP BY 1, 2 HAVING count(DISTINCT person) > 1""")
def conflicts(spark, sf_dir):
    return E.conflicts(*_pair(spark, sf_dir))


@query(f"WITH RECURSIVE {CONTACTS}, same AS (SELECT src AS a, dst AS b FROM contacts WHERE weight >= 2), both_ AS (SELECT a, b FROM same UNION SELECT b, a FROM same), reach(p, q) AS (SELECT a, a FROM both_ UNION SELECT r.p, s.b FROM reach r JOIN both_ s ON r.q = s.a) SELECT p AS person, min(q) AS cluster FROM reach GROUP BY 1")
def identity_clusters(spark, sf_dir):
    """Users that share property hours at least twice count as the same."""
    return E.identity_clusters(contacts(spark, sf_dir).where("weight >= 2").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"WITH {CALLS}, {HOLDINGS}, {JOIN}, {EDGES}, both_ AS (SELECT src AS person, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) SELECT person, count(DISTINCT other) AS counterparts FROM both_ GROUP BY 1 HAVING count(DISTINCT other) >= 6")
def hubs(spark, sf_dir):
    return E.hubs(E.call_edges(*_pair(spark, sf_dir)))


@query(f"WITH {CALLS} SELECT b.event_id AS derivative, a.event_id AS origin, a.caller, a.callee FROM calls a JOIN calls b ON a.caller = b.caller AND a.callee = b.callee AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000")
def lineage_same_event(spark, sf_dir):
    return E.same_event_links(calls(spark, sf_dir))


LINKS = "links AS (SELECT doc_id AS derivative, doc_id // 2 AS origin FROM documents WHERE doc_id % 5 <> 0 AND doc_id > 1)"


@query(f"""WITH RECURSIVE {LINKS}, up(item, o) AS (SELECT derivative, origin FROM links UNION ALL SELECT item, origin FROM up JOIN links ON o = derivative)
SELECT item, o AS root FROM up WHERE NOT EXISTS (SELECT 1 FROM links WHERE derivative = o)""")
def lineage_roots(spark, sf_dir):
    """Documents derived from the one of half their number, but for every fifth."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0 and doc_id > 1")
    return E.lineage_roots(docs.select(F.col("doc_id").alias("derivative"), F.expr("doc_id div 2").alias("origin")))


@query("""WITH l AS (SELECT doc_id AS derivative, doc_id // 3 AS origin, 'same_event' AS basis, 2 AS r FROM documents WHERE doc_id > 2 UNION ALL SELECT doc_id, doc_id // 2, 'near_verbatim', 1 FROM documents WHERE doc_id > 1 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, doc_id - 1, 'declared', 0 FROM documents WHERE doc_id % 7 = 1)
SELECT derivative, origin, basis FROM (SELECT *, row_number() OVER (PARTITION BY derivative ORDER BY r, origin) AS n FROM l) WHERE n = 1""")
def lineage_links(spark, sf_dir):
    d, b = F.col("doc_id").alias("derivative"), lambda t: F.lit(t).alias("basis")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    s = docs.where("doc_id > 2").select(d, F.expr("doc_id div 3").alias("origin"), b("same_event"))
    n = docs.where("doc_id > 1 and doc_id % 3 = 0").select(d, F.expr("doc_id div 2").alias("origin"), b("near_verbatim"))
    return E.one_link_each(s.unionByName(n).unionByName(docs.where("doc_id % 7 = 1").select(d, (F.col("doc_id") - 1).alias("origin"), b("declared"))))


@query(f"""WITH RECURSIVE {LINKS}, up(item, o) AS (SELECT derivative, origin FROM links UNION ALL SELECT item, origin FROM up JOIN links ON o = derivative),
roots AS (SELECT item, o AS root FROM up WHERE NOT EXISTS (SELECT 1 FROM links WHERE derivative = o)), named AS (SELECT d.doc_id AS key, d.source, coalesce(root, d.doc_id) AS o FROM documents d LEFT JOIN roots ON item = d.doc_id)
SELECT coalesce(r.source, n.source) AS family, count(*) AS statements FROM named n LEFT JOIN documents r ON r.doc_id = n.o WHERE n.key % 11 <> 3 AND n.o % 11 <> 3 AND coalesce(r.source, n.source) <> 'src1' GROUP BY 1""")
def active_assertions(spark, sf_dir):
    """Documents as statements, their source as artifact: disputed ones and their copies are out, and so is family src1."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("artifact"))
    states = docs.where("key % 11 = 3").select("key", F.lit("disputed").alias("state"))
    withdrawn = spark.createDataFrame([("src1",)], "family string")
    return E.active_assertions(docs, lineage_roots(spark, sf_dir), states, withdrawn).groupBy("family").agg(F.count("*").alias("statements"))


@query(f"""WITH RECURSIVE {CONTACTS}, e AS (SELECT src, dst, CASE WHEN weight >= 2 THEN 0 ELSE 1 END AS cost FROM contacts UNION ALL SELECT dst, src, CASE WHEN weight >= 2 THEN 0 ELSE 1 END FROM contacts),
d(node, cost) AS (SELECT (SELECT min(src) FROM contacts), 0 UNION SELECT e.dst, d.cost + e.cost FROM d JOIN e ON d.node = e.src WHERE d.cost + e.cost <= 3) SELECT node, min(cost) AS cost FROM d GROUP BY 1""")
def firm_distance(spark, sf_dir):
    """From the smallest user: strong contacts are identity steps."""
    c = contacts(spark, sf_dir).select("src", "dst", F.when(F.col("weight") >= 2, 0).otherwise(1).alias("cost"))
    start = c.agg(F.min("src").alias("node"))
    return E.firm_distance(c.unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")), start)


OWNERS = "owners AS (SELECT 'S' || s_suppkey AS identifier, s_name AS owner FROM supplier WHERE s_suppkey % 3 <> 0)"


@query(f"WITH {TXN}, {OWNERS} SELECT from_account, owner AS from_owner, count(*) AS transfers FROM txn LEFT JOIN owners ON identifier = from_account GROUP BY 1, 2")
def link_transactions(spark, sf_dir):
    """Transfers with the sender's owner where one is known."""
    owners = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("identifier"), F.col("s_name").alias("owner"), F.col("s_suppkey").alias("seq"))
    txn = transactions(spark, sf_dir).withColumn("from_owner", F.lit(None).cast("string"))
    return with_owners(txn, owners, "from_account", "from_owner").groupBy("from_account", "from_owner").agg(F.count("*").alias("transfers"))


@query(f"WITH {CALLS}, o AS (SELECT c_custkey AS identifier, c_name AS owner FROM customer WHERE c_custkey % 2 = 0) SELECT event_id, a.owner AS caller_owner, b.owner AS callee_owner FROM calls LEFT JOIN o a ON a.identifier = caller LEFT JOIN o b ON b.identifier = callee")
def link_calls(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("identifier"), F.col("c_name").alias("owner"), F.col("c_custkey").alias("seq"))
    c = calls(spark, sf_dir).withColumns({"caller_owner": F.lit(None).cast("string"), "callee_owner": F.lit(None).cast("string")})
    return with_owners(with_owners(c, owners, "caller", "caller_owner"), owners, "callee", "callee_owner").select("event_id", "caller_owner", "callee_owner")


# Governance


GRANTS = """grants AS (SELECT c_custkey AS g, 'P' || (c_custkey % 7) AS principal, CASE WHEN c_custkey % 2 = 0 THEN 'fraud' ELSE 'missing' END AS purpose, c_nationkey::BIGINT AS case_id,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS revoked_at, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 400)::INT) END AS expires_at FROM customer),
live AS (SELECT DISTINCT principal, purpose, case_id FROM grants WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-07-01'))"""


def _grants(spark, sf_dir):
    k = F.col("c_custkey")
    expires = F.timestamp_add("DAY", (k % 400).cast("int"), F.to_timestamp(F.lit("2024-01-01")))
    return table(spark, sf_dir, "customer").select(
        k.alias("g"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("principal"), F.when(k % 2 == 0, "fraud").otherwise("missing").alias("purpose"), F.col("c_nationkey").cast("long").alias("case_id"),
        F.when(k % 5 == 0, F.to_timestamp(F.lit("2024-06-01"))).alias("revoked_at"), F.when(k % 3 == 0, expires).alias("expires_at"),
    )


_NOW = "2024-07-01"


@query(f"WITH {GRANTS} SELECT * FROM live")
def authorized_cases(spark, sf_dir):
    return V.authorized_cases(_grants(spark, sf_dir), F.to_timestamp(F.lit(_NOW)))


@query(f"WITH {GRANTS} SELECT principal, substr(sha256(string_agg(purpose || ':' || case_id, '|' ORDER BY purpose || ':' || case_id)), 1, 16) AS version FROM live GROUP BY 1")
def permission_version(spark, sf_dir):
    return V.permission_version(_grants(spark, sf_dir), F.to_timestamp(F.lit(_NOW)))


@query(f"""WITH {GRANTS}, w AS (SELECT 'W' || (s_suppkey % 20) AS workspace, CASE WHEN s_suppkey % 2 = 0 THEN 'fraud' ELSE 'missing' END AS purpose, s_nationkey::BIGINT AS case_id FROM supplier),
asked AS (SELECT workspace, purpose, count(DISTINCT case_id) AS n FROM w GROUP BY 1, 2), given AS (SELECT workspace, purpose, principal, count(*) AS n FROM (SELECT DISTINCT * FROM w) JOIN live USING (purpose, case_id) GROUP BY 1, 2, 3)
SELECT workspace, principal FROM given JOIN asked USING (workspace, purpose, n)""")
def visible_workspaces(spark, sf_dir):
    s = F.col("s_suppkey")
    w = table(spark, sf_dir, "supplier").select(F.concat(F.lit("W"), (s % 20).cast("string")).alias("workspace"), F.when(s % 2 == 0, "fraud").otherwise("missing").alias("purpose"), F.col("s_nationkey").cast("long").alias("case_id"))
    return V.visible_workspaces(w, _grants(spark, sf_dir), F.to_timestamp(F.lit(_NOW)))


@query("SELECT user_id AS key, event_id AS id, version, event_type AS state FROM (SELECT *, trunc(value)::BIGINT % 50 AS version, row_number() OVER (PARTITION BY user_id ORDER BY trunc(value)::BIGINT % 50 DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.col("value").cast("long") % 50).alias("version"), F.col("event_type").alias("state"))
    return E.latest(d, ["key"]).select("key", "id", "version", "state")


@query("""WITH e AS (SELECT user_id AS log_id, event_id AS seq FROM events), n AS (SELECT *, lead(seq) OVER (PARTITION BY log_id ORDER BY seq) AS following FROM e)
SELECT log_id, seq, 'altered' AS problem FROM n WHERE seq % 97 = 5 UNION ALL SELECT log_id, following, 'broken link' FROM n WHERE seq % 101 = 7 AND following IS NOT NULL AND following % 97 <> 5""")
def audit_verify(spark, sf_dir):
    """A hash chain for each user's events, in which some payloads were altered and some entries forged and signed anew."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("payload")).alias("x"))
    chained = """aggregate(array_sort(xs), cast(array() as array<struct<seq: bigint, payload: string, prev_hash: string, hash: string>>), (acc, x) -> concat(acc, array(named_struct(
      'seq', x.seq, 'payload', x.payload, 'prev_hash', coalesce(try_element_at(acc, -1).hash, ''),
      'hash', sha2(concat_ws('|', coalesce(try_element_at(acc, -1).hash, ''), cast(x.seq as string), x.payload), 256)))))"""
    log = e.groupBy("log_id").agg(F.collect_list("x").alias("xs")).select("log_id", F.explode(F.expr(chained)).alias("y")).select("log_id", "y.*")
    forged = V.audit_digest(F.col("prev_hash"), F.col("seq").cast("string"), F.lit("forged"))
    log = log.withColumns({"hash": F.when(F.col("seq") % 101 == 7, forged).otherwise(F.col("hash")), "payload": F.when(F.col("seq") % 101 == 7, "forged").otherwise(F.col("payload"))})
    return V.audit_verify(log.withColumn("payload", F.when(F.col("seq") % 97 == 5, "altered").otherwise(F.col("payload"))))


@query("SELECT lang AS case_id, min(doc_id) AS id, count(*) AS copies, sha256(text) AS sha256 FROM documents GROUP BY lang, text")
def dedupe_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return V.dedupe_content(docs)


@query("""WITH m AS (SELECT doc_id AS name, CASE WHEN doc_id % 9 = 4 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 10 <> 3), f AS (SELECT doc_id AS name, sha256(text) AS found FROM documents WHERE doc_id % 7 <> 2)
SELECT coalesce(m.name, f.name) AS name, CASE WHEN sha IS NULL THEN 'unlisted' WHEN found IS NULL THEN 'missing' WHEN found = sha THEN 'intact' ELSE 'altered' END AS status FROM m FULL JOIN f ON m.name = f.name""")
def store_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    manifest = docs.where("name % 10 <> 3").select("name", F.when(F.col("name") % 9 == 4, "x").otherwise(F.sha2("content", 256)).alias("sha256"))
    return V.store_verify(manifest, docs.where("name % 7 <> 2"))


@query("WITH r AS (SELECT o_orderkey AS run, o_custkey AS workspace, o_orderkey % 4 AS version, o_orderkey % 13 = 0 AS failed FROM orders) SELECT run, CASE WHEN failed THEN 'failed' WHEN version <> c_custkey % 4 THEN 'stale' ELSE 'complete' END AS status FROM r JOIN customer ON c_custkey = workspace")
def scenario_status(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run"), F.col("o_custkey").alias("workspace"), (k % 4).alias("version"), (k % 13 == 0).alias("failed"))
    return V.scenario_status(runs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace"), (F.col("c_custkey") % 4).alias("version")))


@query("SELECT count(*) AS kept, c_nationkey::BIGINT AS case_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 2")
def purge_case(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("case_id"))
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("case_id"))
    return V.purge(rows, gone).groupBy("case_id").agg(F.count("*").alias("kept"))


@query("SELECT 'review' AS kind, o_orderkey AS id, o_custkey % 9 AS version, o_orderpriority AS subject, o_orderstatus AS state FROM orders UNION ALL SELECT 'grouping', s_suppkey, s_suppkey % 9, s_name, 'accepted' FROM supplier")
def decision_history(spark, sf_dir):
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("version"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("state"))
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9).alias("version"), F.col("s_name").alias("subject"), F.lit("accepted").alias("state"))
    return V.decision_history(("review", reviews), ("grouping", groups))


@query("""WITH RECURSIVE w AS (SELECT n_nationkey AS workspace, 1 + n_nationkey % 3 AS version FROM nation), q AS (SELECT c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 1000 ELSE 0 END AS workspace, 1 + c_custkey % 4 AS expected, c_custkey AS id FROM customer),
taken(workspace, expected, id) AS (SELECT w.workspace, version, min(id) FROM w JOIN q ON q.workspace = w.workspace AND expected = version GROUP BY 1, 2
  UNION ALL SELECT t.workspace, t.expected + 1, min(q.id) FROM taken t JOIN q ON q.workspace = t.workspace AND q.expected = t.expected + 1 AND q.id > t.id GROUP BY 1, 2)
SELECT q.id, CASE WHEN w.version IS NULL THEN 'unknown workspace' WHEN t.id IS NOT NULL THEN 'version ' || (q.expected + 1) ELSE 'stale version' END AS outcome FROM q LEFT JOIN w USING (workspace) LEFT JOIN taken t ON t.workspace = q.workspace AND t.id = q.id""")
def versioned_decisions(spark, sf_dir):
    """Customers' decisions on their nations' workspaces in the order of their numbers: those that expect the version at their turn are taken."""
    k = F.col("c_custkey")
    workspaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("workspace"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("version"))
    asked = table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") + F.when(k % 50 == 0, 1000).otherwise(0)).cast("long").alias("workspace"), (k % 4 + 1).alias("expected"), k.alias("id"), F.col("c_name").alias("subject"), F.lit("accepted").alias("state"),
    )
    taken, refused = V.apply_decisions(workspaces, asked)
    return taken.select("id", F.concat(F.lit("version "), F.col("version").cast("string")).alias("outcome")).unionByName(refused.select("id", F.col("reason").alias("outcome")))


@query("SELECT n_nationkey::BIGINT AS workspace, 1 + (n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 3))::BIGINT AS version FROM nation")
def workspace_versions(spark, sf_dir):
    """Nations' workspaces after new evidence on some customers' cases."""
    workspaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("workspace"), F.lit(1).cast("long").alias("version"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("workspace"), F.col("c_custkey").alias("case_id"))
    return V.bump_versions(workspaces, cases, cases.where("case_id % 40 = 3"))


# Vision


LABELS = ("person", "car", "backpack", "knife", "cell phone", "dog", "truck", "handbag", "laptop", "person")
_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
DETECTIONS = f"""det AS (SELECT user_id AS run, event_id % 5 AS frame, ({_LABEL_SQL})[1 + (event_id * 7 + user_id) % 10] AS label FROM events),
rel AS (SELECT *, CASE WHEN label IN ('car', 'truck') THEN 'vehicle' WHEN label IN ('backpack', 'handbag') THEN 'carried' WHEN label IN ('cell phone', 'laptop') THEN 'device' WHEN label = 'knife' THEN 'weapon' WHEN label = 'person' THEN 'person' ELSE 'ambient' END AS r FROM det),
fr AS (SELECT run, frame, count(*) FILTER (label = 'person') AS people, max((r = 'carried')::INT) AS carried, max((r = 'vehicle')::INT) AS vehicle, max((r = 'weapon')::INT) AS weapon, max((r = 'device')::INT) AS device FROM rel GROUP BY 1, 2),
ru AS (SELECT run, max(people) AS peak, count(*) FILTER (people > 0 AND carried > 0) AS carried, count(*) FILTER (vehicle > 0) AS vehicle, count(*) FILTER (weapon > 0) AS weapon, count(*) FILTER (device > 0) AS device FROM fr GROUP BY 1),
pk AS (SELECT run, count(*) AS n FROM fr JOIN ru USING (run) WHERE people = peak AND peak > 0 GROUP BY 1),
clues AS (SELECT run, 'group' AS kind, CASE WHEN peak >= 4 THEN 'high' ELSE 'medium' END AS severity, n AS frames FROM ru JOIN pk USING (run) WHERE peak >= 2
  UNION ALL SELECT run, 'presence', 'low', n FROM ru JOIN pk USING (run) WHERE peak = 1 UNION ALL SELECT run, 'carried_item', 'medium', carried FROM ru WHERE carried > 0
  UNION ALL SELECT run, 'vehicle', 'medium', vehicle FROM ru WHERE vehicle >= 2 UNION ALL SELECT run, 'weapon', 'high', weapon FROM ru WHERE weapon > 0
  UNION ALL SELECT run, 'device', 'low', device FROM ru WHERE device > 0 UNION ALL SELECT run, 'none', 'low', 0 FROM ru WHERE peak = 0 AND vehicle < 2 AND weapon = 0 AND device = 0)"""


def _detections(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in LABELS])
    at = ((F.col("event_id") * 7 + F.col("user_id")) % 10 + 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 5).alias("frame"), F.element_at(labels, at).alias("label"))


@query(f"WITH {DETECTIONS} SELECT * FROM clues")
def vision_clues(spark, sf_dir):
    return N.clues(_detections(spark, sf_dir))


@query(f"WITH {DETECTIONS}, l AS (SELECT run, label, count(*) AS n FROM det GROUP BY 1, 2), t AS (SELECT run, label AS top_label, count(*) OVER (PARTITION BY run) AS labels, row_number() OVER (PARTITION BY run ORDER BY n DESC, label) AS p FROM l) SELECT run, count(DISTINCT frame) AS frames, count(*) AS detections, any_value(top_label) AS top_label, any_value(labels) AS labels FROM det JOIN t USING (run) WHERE p = 1 GROUP BY 1")
def vision_summary(spark, sf_dir):
    return N.summary(_detections(spark, sf_dir))


@query(f"WITH {DETECTIONS} SELECT run, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS clues FROM clues GROUP BY 1")
def vision_alert(spark, sf_dir):
    return N.alert(N.clues(_detections(spark, sf_dir)))
