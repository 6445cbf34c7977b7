"""Findings, resolution and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import extraction as T
from ..operators import findings as C
from ..operators import resolution as R
from ..sources.adapters import calls, contacts, holdings, table
from ..sources.storage import stored
from .registry import CALLS, CONTACTS, HOLDINGS, query

#: The contact graph as connections: strong contacts are identity steps, some of them provisional; every tenth user is accused.
GRAPH = f"""{CONTACTS}, e AS (SELECT src, dst, CASE WHEN weight >= 2 THEN 0 ELSE 1 END AS cost, weight >= 2 AND (src + dst) % 3 = 0 AS prov FROM contacts
  UNION ALL SELECT dst, src, CASE WHEN weight >= 2 THEN 0 ELSE 1 END, weight >= 2 AND (src + dst) % 3 = 0 FROM contacts),
deg AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), hubs AS (SELECT node FROM deg WHERE n >= 6 AND node % 10 <> 0), acc AS (SELECT node FROM deg WHERE node % 10 = 0),
pairs AS (SELECT x.node AS a, y.node AS b FROM acc x JOIN acc y ON x.node < y.node AND x.node % 3 <> y.node % 3)"""
FULL = "d(a, node, cost) AS (SELECT DISTINCT a, a, 0 FROM pairs UNION SELECT d.a, e.dst, d.cost + e.cost FROM d JOIN e ON d.node = e.src WHERE d.cost + e.cost <= 3), dist AS (SELECT a, node AS b, min(cost) AS distance FROM d GROUP BY 1, 2)"
FIRM = "f(a, node, cost) AS (SELECT DISTINCT a, a, 0 FROM pairs UNION SELECT f.a, e.dst, f.cost + e.cost FROM f JOIN e ON f.node = e.src WHERE NOT e.prov AND f.cost + e.cost <= 3 AND (f.cost = 0 OR f.node NOT IN (FROM hubs))), firm AS (SELECT a, node AS b, min(cost) AS firm FROM f GROUP BY 1, 2)"


def _graph(spark, sf_dir):
    c = stored(contacts(spark, sf_dir), "contacts")
    e = c.select("src", "dst", F.when(F.col("weight") >= 2, 0).otherwise(1).alias("cost"), ((F.col("weight") >= 2) & ((F.col("src") + F.col("dst")) % 3 == 0)).alias("provisional"))
    edges = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "provisional"))
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    hubs = degree.where("n >= 6 and node % 10 <> 0").select("node")
    accused = degree.where("node % 10 = 0").select("node", (F.col("node") % 3).alias("case_id"))
    # Accused people are few; pairs are of different cases, so the case stands in the join.
    a, b = accused.toDF("a", "ca"), accused.toDF("b", "cb").withColumn("ca", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).where("ca <> cb")
    return edges, a.join(b, "ca").where("a < b").select("a", "b"), hubs


@query(f"WITH RECURSIVE {GRAPH}, {FULL} SELECT p.a, p.b, distance FROM pairs p JOIN dist USING (a, b)")
def pair_distances(spark, sf_dir):
    edges, pairs, _ = _graph(spark, sf_dir)
    return C.pair_distances(edges, pairs)


@query(f"WITH RECURSIVE {GRAPH}, {FULL}, {FIRM} SELECT p.a, p.b, CASE WHEN firm IS NULL THEN 'lead' ELSE 'supported' END AS status, coalesce(firm, distance) AS distance FROM pairs p JOIN dist USING (a, b) LEFT JOIN firm USING (a, b)")
def findings(spark, sf_dir):
    edges, pairs, hubs = _graph(spark, sf_dir)
    return C.findings(edges, pairs, hubs)


@query(f"""WITH RECURSIVE {GRAPH}, {FULL}, {FIRM}, ours AS (SELECT p.a, p.b, CASE WHEN firm IS NULL THEN 'lead' ELSE 'supported' END AS status FROM pairs p JOIN dist USING (a, b) LEFT JOIN firm USING (a, b))
SELECT status AS ours, count(*) AS pairs FROM ours GROUP BY 1""")
def contrast(spark, sf_dir):
    """What the naive view, which asserts every connected pair, becomes when identities and hubs are weighed."""
    edges, pairs, hubs = _graph(spark, sf_dir)
    # The naive view's pairs are those that findings tell of: all within the limit.
    return C.findings(edges, pairs, hubs).groupBy(F.col("status").alias("ours")).agg(F.count("*").alias("pairs"))


@query(f"""WITH RECURSIVE {GRAPH}, x(node, cost) AS (SELECT (SELECT min(node) FROM acc), 0 UNION SELECT e.dst, x.cost + e.cost FROM x JOIN e ON x.node = e.src WHERE x.cost + e.cost <= 3), da AS (SELECT node, min(cost) AS c FROM x GROUP BY 1),
y(node, cost) AS (SELECT (SELECT max(node) FROM acc), 0 UNION SELECT e.dst, y.cost + e.cost FROM y JOIN e ON y.node = e.src WHERE y.cost + e.cost <= 3), db AS (SELECT node, min(cost) AS c FROM y GROUP BY 1)
SELECT src, dst, cost FROM e JOIN da ON da.node = src JOIN db ON db.node = dst WHERE da.c + cost + db.c <= 3""")
def relevant_edges(spark, sf_dir):
    """Edges that lie on a short way between the smallest and the largest accused user."""
    edges, _, _ = _graph(spark, sf_dir)
    accused = edges.select(F.col("src").alias("node")).where("node % 10 = 0")
    return C.relevant_edges(edges, accused.agg(F.min("node").alias("node")), accused.agg(F.max("node").alias("node")))


@query()
def withdrawal_sets(spark, sf_dir):
    """Source families (six of calls, and holdings by kind) whose loss parts a pair of callers, for all pairs with a call."""
    d = E.edge_derivations(calls(spark, sf_dir), holdings(spark, sf_dir))
    d = d.withColumn("family", F.when(F.col("atom").startswith("e"), F.concat(F.lit("calls-"), F.pmod(F.xxhash64("atom"), F.lit(6)).cast("string"))).otherwise(F.substring("atom", 1, 1)))
    both = d.unionByName(d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "derivation", "atom", "family"))
    pairs = both.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return C.withdrawal_sets(both, pairs).select("a", "b", F.array_join(F.array_sort("withdrawn"), "+").alias("withdrawn"), "exhaustive")


@query(f"WITH {CALLS}, {HOLDINGS}, a AS (SELECT 'e' || event_id AS atom FROM calls UNION ALL SELECT holding FROM holdings) SELECT substr(atom, 1, 1) AS family, count(*) AS weight FROM a GROUP BY 1")
def family_weights(spark, sf_dir):
    """Statements of each kind."""
    atoms = calls(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("atom")).union(holdings(spark, sf_dir).select("holding"))
    return C.family_weights(atoms.select(F.substring("atom", 1, 1).alias("family")))


# Resolution


@query("""SELECT 'PHONE' AS type, CASE WHEN length(v) = 12 AND v LIKE '91%' THEN substr(v, 3) ELSE v END AS key, count(*) AS mentions, min(surface) AS surface, count(DISTINCT surface) AS surfaces FROM (
  SELECT surface, upper(regexp_replace(surface, '[ \\-+()]', '', 'g')) AS v FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '+91 ' ELSE '' END || (6000000000 + o_custkey) AS surface FROM orders)) GROUP BY 2""")
def resolve_exact(spark, sf_dir):
    k = F.col("o_orderkey")
    surface = F.concat(F.when(k % 2 == 0, "+91 ").otherwise(""), (F.col("o_custkey") + 6000000000).cast("string"))
    return R.resolve_exact(table(spark, sf_dir, "orders").select(F.lit("PHONE").alias("type"), surface.alias("surface")))


@query()
def resolve_fuzzy(spark, sf_dir):
    return R.resolve_fuzzy(table(spark, sf_dir, "part").select(F.lit("PERSON").alias("type"), F.col("p_name").alias("name")))


@query("""WITH c AS (SELECT DISTINCT p_name AS name, p_type AS cluster FROM part)
SELECT DISTINCT cluster, CASE WHEN cluster IN (SELECT cluster FROM c WHERE cluster LIKE 'S%') THEN (SELECT min(cluster) FROM c WHERE cluster LIKE 'S%') ELSE cluster END AS "into" FROM c""")
def alias_fold(spark, sf_dir):
    """Clusters are part types; every type with S has an alias to the first of them."""
    part = table(spark, sf_dir, "part")
    clusters = part.select(F.concat_ws("#", "p_type", "p_name").alias("name"), F.col("p_type").alias("cluster")).distinct()
    s = clusters.where("cluster like 'S%'")
    first = s.agg(F.min(F.struct("cluster", "name")).alias("m")).select("m.name").withColumnRenamed("name", "person")
    # One row on the left: its name is written to each alias by a scalar subquery's value.
    person = first.first()
    aliases = s.select(F.lit(person.person if person else None).alias("person"), F.col("name").alias("alias"))
    return R.alias_fold(clusters, aliases)


@query("""WITH f AS (SELECT 'PART' AS type, p_brand AS name, p_type AS a FROM part UNION ALL SELECT 'PART', p_brand, p_name FROM part WHERE p_partkey % 3 = 0)
SELECT type, name, array_to_string(list_sort(list_distinct(list(a))), ',') AS aliases FROM f WHERE a <> name GROUP BY 1, 2""")
def upsert_entities(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    row = lambda c, t: t.select(F.lit("PART").alias("type"), F.col("p_brand").alias("name"), F.array(c).alias("aliases"))
    return R.upsert_entities(row("p_type", part), row("p_name", part.where("p_partkey % 3 = 0"))).withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH b AS (SELECT l_suppkey AS src, l_partkey % 20 AS dst, l_returnflag AS rel_type, 1 AS weight, l_orderkey * 10 + l_linenumber AS seq, l_linestatus || l_orderkey AS snippet FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, rel_type ORDER BY seq, snippet) AS n FROM b)
SELECT src, dst, rel_type, sum(weight)::BIGINT AS weight, string_agg(snippet, ' | ' ORDER BY n) FILTER (n <= 8) AS evidence FROM r GROUP BY 1, 2, 3""")
def upsert_relationships(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.col("l_returnflag").alias("rel_type"), F.lit(1).alias("weight"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat("l_linestatus", F.col("l_orderkey").cast("string")).alias("snippet"),
    )
    return R.upsert_relationships(li.where("seq % 2 = 0"), li.where("seq % 2 = 1"))


@query("SELECT DISTINCT lower(c_name) AS owner, CASE WHEN c_custkey % 2 = 0 THEN (6000000000 + c_custkey)::VARCHAR ELSE 'AC' || c_custkey END AS identifier, CASE WHEN c_custkey % 3 = 0 THEN 'PHONE' WHEN c_custkey % 2 = 0 THEN 'PHONE' ELSE 'BANK_ACCOUNT' END AS type FROM customer")
def owns_edges(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.when(k % 2 == 0, F.concat(F.lit("+91 "), (k + 6000000000).cast("string"))).otherwise(F.concat(F.lit("ac-"), k.cast("string")))
    return R.owns_edges(table(spark, sf_dir, "customer").select(F.col("c_name").alias("owner_name"), value.alias("identifier"), F.when(k % 3 == 0, "phone").alias("identifier_type")))


@query(f"""WITH {HOLDINGS}, p AS (SELECT DISTINCT person, person % 4 AS case_id, 'name ' || (person % 50) AS tokens FROM holdings),
n AS (SELECT x.person AS a, y.person AS b, true AS by_name, false AS by_number FROM p x JOIN p y ON x.tokens = y.tokens AND x.person < y.person AND x.case_id <> y.case_id),
s AS (SELECT DISTINCT x.person AS a, y.person AS b FROM holdings x JOIN holdings y ON x.identifier = y.identifier AND x.person < y.person WHERE (x.starts IS NULL OR y.ends IS NULL OR x.starts < y.ends) AND (y.starts IS NULL OR x.ends IS NULL OR y.starts < x.ends)),
m AS (SELECT a, b, false AS by_name, true AS by_number FROM s WHERE a % 4 <> b % 4) SELECT a, b, bool_or(by_name) AS by_name, bool_or(by_number) AS by_number FROM (FROM n UNION ALL FROM m) GROUP BY 1, 2""")
def identity_candidates(spark, sf_dir):
    h = holdings(spark, sf_dir)
    people = h.select("person").distinct().select("person", (F.col("person") % 4).alias("case_id"), F.concat(F.lit("name "), (F.col("person") % 50).cast("string")).alias("tokens"))
    return R.identity_candidates(people, E.shared_identifiers(h))


# Extraction


@query("SELECT event_id AS row_id, 'CONTACT' AS predicate, 'PHONE:' || (6000000000 + user_id) AS subject, 'PHONE:' || (7000000000 + event_id) AS object, ts AS starts, CASE WHEN event_id % 4 <> 0 THEN trunc(value)::BIGINT || 's' END AS detail FROM events WHERE event_id % 9 <> 0")
def ext_call_assertions(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        k.alias("row_id"), F.concat(F.lit("+91 "), (F.col("user_id") + 6000000000).cast("string")).alias("caller"), F.concat(F.lit("0"), (k + 7000000000).cast("string")).alias("callee"),
        F.when(k % 9 != 0, F.col("ts")).alias("timestamp"), F.when(k % 4 != 0, F.col("value")).alias("duration_sec"),
    )
    return T.contact_statements(rows)


@query("SELECT o_orderkey AS row_id, 'TRANSFER' AS predicate, 'ACCOUNT:C' || o_custkey AS subject, 'ACCOUNT:' || upper(replace(o_orderpriority, '-', '')) AS object, o_orderdate AS starts, CASE WHEN o_orderkey % 5 <> 0 THEN (1000 + o_orderkey)::DOUBLE END AS amount FROM (SELECT * REPLACE (replace(o_orderpriority, ' ', '') AS o_orderpriority) FROM orders)")
def ext_transfer_assertions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("row_id"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("from_account"), F.col("o_orderpriority").alias("to_account"),
        F.when(k % 5 != 0, F.format_number(k + 1000, 0)).otherwise("n/a").alias("amount"), F.col("o_orderdate").alias("timestamp"),
    )
    return T.transfer_statements(rows)


_HELD = """h AS (SELECT c_custkey AS row_id, 'P:K' || (c_nationkey % 3) || ':' || lower(c_name) AS subject, c_custkey AS k, DATE '2024-01-01' + (c_custkey % 60)::INT AS starts, DATE '2024-01-31' + 1 AS ends FROM customer),
hs AS (SELECT row_id, 'HOLDS' AS predicate, subject, 0 AS ordinal, CASE WHEN k % 2 = 0 THEN 'PHONE:' || (6000000000 + k) ELSE 'ACCOUNT:' || (500000000000 + k) END AS object, starts, ends FROM h WHERE starts < ends
  UNION ALL SELECT row_id, 'HOLDS', subject, 1, 'PHONE:' || (9000000000 + k), starts, ends FROM h WHERE k % 5 = 0 AND starts < ends)"""


def _subscribers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("row_id"), F.concat(F.lit("K"), (F.col("c_nationkey") % 3).cast("string")).alias("case_code"), F.concat(F.lit("Mr. "), "c_name").alias("owner_name"),
        F.when(k % 2 == 0, (k + 6000000000).cast("string")).otherwise((k + 500000000000).cast("string")).alias("identifier"), F.lit(None).cast("string").alias("identifier_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("valid_from"), F.lit("2024-01-31").alias("valid_to"), F.when(k % 5 == 0, (k + 9000000000).cast("string")).alias("registered_mobile"),
    )


@query(f"WITH {_HELD} SELECT * FROM hs")
def ext_holdings(spark, sf_dir):
    return T.holding_statements(_subscribers(spark, sf_dir))


@query(f"WITH {_HELD}, o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ordinal) - 1 AS n FROM hs) SELECT row_id, ordinal, 'a-' || substr(sha256('K' || chr(31) || 'file' || chr(31) || 'row:' || row_id || chr(31) || n), 1, 16) AS key FROM o")
def ext_assertion_keys(spark, sf_dir):
    held = T.holding_statements(_subscribers(spark, sf_dir)).withColumn("case_code", F.lit("K"))
    return T.statement_keys(held, F.lit("file"), F.concat(F.lit("row:"), F.col("row_id").cast("string"))).select("row_id", "ordinal", "key")


@query("SELECT doc_id, field, value FROM (SELECT doc_id, 'fir' AS field, doc_id::VARCHAR AS value FROM documents UNION ALL SELECT doc_id, 'accused', lang || ', Nil and ' || source FROM documents UNION ALL SELECT doc_id, 'date', '2024-01-01' FROM documents WHERE doc_id % 2 = 0)")
def ext_report_header(spark, sf_dir):
    """Headers put before the documents' texts; after an unknown key nothing counts."""
    other = F.when(F.col("doc_id") % 2 == 0, "Date").otherwise("Weather")
    text = F.concat(F.lit("FIR: "), F.col("doc_id").cast("string"), F.lit("\nAccused : "), "lang", F.lit(", Nil and "), "source", F.lit("\n"), other, F.lit(": 2024-01-01\n\nStation: none\n"), "text")
    return T.report_headers(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "field", "value")


@query("SELECT doc_id, unnest([lang, source]) AS name FROM documents")
def ext_accused(spark, sf_dir):
    text = F.concat(F.lit("Accused: "), "lang", F.lit(", Nil and "), "source", F.lit("\n\nx"))
    return T.accused(T.report_headers(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))))


_CLAIMS = """k AS (SELECT c_custkey AS k, 'P:C' || (c_custkey % 3) || ':' || least(chr((97 + c_custkey % 26)::INT) || 'x', 'person') || ' ' || greatest(chr((97 + c_custkey % 26)::INT) || 'x', 'person') AS a, 'P:C' || (c_custkey % 3) || ':' || least(chr((97 + (c_custkey + 1) % 26)::INT) || 'x', 'person') || ' ' || greatest(chr((97 + (c_custkey + 1) % 26)::INT) || 'x', 'person') AS b FROM customer)"""


@query(f"""WITH {_CLAIMS} SELECT k AS doc_id, 0 AS sentence_no, 'LINK' AS predicate, a AS subject, b AS object, DATE '2024-05-03' AS day, 1 AS polarity, 'called' AS detail FROM k
UNION ALL SELECT k, 1, 'LINK', a, b, NULL, -1, 'denied' FROM k WHERE k % 2 = 1
UNION ALL SELECT k, 1 + (k % 2)::INT, 'HOLDS', a, 'PHONE:' || (6000000000 + k), DATE '2024-04-01' + (k % 9)::INT, 1, 'stated in report' FROM k""")
def ext_claims(spark, sf_dir):
    """Reports made of customers: a call, for odd ones a denial, and whose a number is."""
    from ..operators import text as X

    k = F.col("c_custkey")
    who = lambda n: F.concat(F.lit("Person "), F.chr((k + n) % 26 + 65), F.lit("x"))
    denial = F.when(k % 2 == 1, F.concat(who(0), F.lit(" denied knowing "), who(1), F.lit(". "))).otherwise("")
    head = F.concat(F.lit("FIR No.: "), k.cast("string"), F.lit("\nDate: "), F.date_add(F.lit("2024-04-01").cast("date"), (k % 9).cast("int")).cast("string"), F.lit("\n\n"))
    body = F.concat(who(0), F.lit(" called his associate "), who(1), F.lit(" on 3 May 2024. "), denial, F.lit("Number "), (k + 6000000000).cast("string"), F.lit(" is with "), who(0), F.lit("."))
    reports = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("C"), (k % 3).cast("string")).alias("case_code"), F.concat(head, body).alias("text"))
    days = T.report_headers(reports).where("field = 'date'").select("doc_id", F.to_date("value").alias("document_day"))
    bodies = stored(T.report_bodies(reports).join(reports.select("doc_id", "case_code"), "doc_id").join(days, "doc_id"), "claims-bodies")
    people = [(f"Person {chr(65 + i)}x", "PERSON") for i in range(26)]
    return T.claims(bodies, X.entities(bodies.select("doc_id", F.col("body").alias("text")), people))


@query("SELECT o_orderkey AS id, ['called', 'associated', 'denied', 'paid', NULL, 'called'][o_custkey % 6 + 1] AS cue FROM orders")
def link_cue(spark, sf_dir):
    """Orders as sentences, whose words between and after two names their customer picks."""
    rows = [(" called his associate ", ""), (" and ", " met in town"), (" denied knowing ", ""), (" remitted ", ""), (" near ", " met"), (" & ", " were in touch")]
    gaps, afters = (F.array(*(F.lit(r[i]) for r in rows)) for i in (0, 1))
    k = (F.col("o_custkey") % 6).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.link_cue(F.get(gaps, k), F.get(afters, k)).alias("cue"))


@query("WITH o AS (SELECT o_orderkey AS id, o_orderpriority || o_custkey AS reference FROM orders) SELECT b.id AS derivative, min(a.id) AS origin FROM o a JOIN o b ON a.reference = b.reference AND a.id < b.id GROUP BY 1")
def lineage_declared(spark, sf_dir):
    """Orders that state an earlier order's reference (priority and customer)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("reference"))
    first = o.groupBy("reference").agg(F.min("id").alias("origin"))
    return o.join(first, "reference").where("id > origin").select(F.col("id").alias("derivative"), "origin")


@query()
def lineage_near_verbatim(spark, sf_dir):
    """Names on one proposition (brand and first letter) whose wording is 85 alike: the later derives from the earlier."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.substring("p_name", 1, 1)).alias("proposition"), S.wording(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return R.near_verbatim(p)


@query("SELECT user_id AS lane, event_type AS type, (ts + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS marks, count(*) FILTER (event_id % 10 = 0) AS ambiguous FROM events GROUP BY ALL")
def timeline_marks(spark, sf_dir):
    """Events of each lane, Indian day and type, and those with more than one reading (every tenth)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("lane"), F.col("event_type").alias("type"), S.ist_day(F.col("ts")).alias("day")).agg(F.count("*").alias("marks"), F.count_if(F.col("event_id") % 10 == 0).alias("ambiguous"))


@query("SELECT source AS family, count(*) AS observations, count(DISTINCT lang) AS documents, count(*) FILTER (doc_id % 2 = 0) AS records, count(*) FILTER (doc_id % 2 = 1) AS claims, min(doc_id) AS origin FROM documents GROUP BY 1")
def support_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("family")).agg(F.count("*").alias("observations"), F.countDistinct("lang").alias("documents"), F.count_if(F.col("doc_id") % 2 == 0).alias("records"), F.count_if(F.col("doc_id") % 2 == 1).alias("claims"), F.min("doc_id").alias("origin"))


@query("SELECT source AS package, count(*) AS files, sha256(string_agg(h, ',' ORDER BY h)) AS manifest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY 1")
def package_manifest(spark, sf_dir):
    """A digest of the sorted file digests of each package."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.sha2("text", 256).alias("h"))
    return d.groupBy("package").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("manifest"))


@query("SELECT page_id, regexp_matches(url, '^(https?|rtsps?)://[^/?#]+') AND NOT regexp_matches(url, '^[a-z]+://(localhost|127\\.|10\\.|192\\.168\\.)') AS allowed FROM pages")
def vision_url_guard(spark, sf_dir):
    """Camera addresses: a known scheme, a host, and not a private one."""
    u = F.col("url")
    ok = u.rlike(r"^(https?|rtsps?)://[^/?#]+") & ~u.rlike(r"^[a-z]+://(localhost|127\.|10\.|192\.168\.)")
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"))


@query("SELECT o_orderkey AS video, n AS place, n * greatest(1, total // 12) AS frame FROM (SELECT o_orderkey, 1 + o_custkey % 500 AS total FROM orders), (SELECT unnest(range(12)) AS n) WHERE n * greatest(1, total // 12) < total")
def vision_sample_index(spark, sf_dir):
    """Twelve frames at most, evenly spaced, of videos of so many frames."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_custkey") % 500 + 1).alias("total"))
    step = F.greatest(F.lit(1), F.expr("total div 12"))
    rows = v.select("video", F.posexplode(F.slice(F.sequence(F.lit(0), F.col("total") - 1, step), 1, 12)).alias("place", "frame"))
    return rows


@query("SELECT c_custkey AS finding, 1 + c_custkey % 3 AS last_version FROM customer WHERE c_custkey % 4 = 1")
def retired_findings(spark, sf_dir):
    """Findings of older snapshots that the newest lacks, with the version that last held them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding"))
    seen = c.select("finding", F.explode(F.sequence(F.lit(1).cast("long"), F.col("finding") % 3 + 1)).alias("version"))
    current = c.where("finding % 4 <> 1")
    return seen.groupBy("finding").agg(F.max("version").alias("last_version")).join(current, "finding", "left_anti")
