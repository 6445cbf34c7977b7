"""Queries of case views: lists, queues, timelines and what decisions would change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import findings as C
from ..operators import fingerprint
from ..operators import graph as G
from ..operators import text as X
from ..operators.ranks import placed
from ..sources import records as R
from ..sources.adapters import calls, contacts, holdings, table
from ..sources.storage import checkpoint_root, stored
from .alerts import ENVELOPE, _alerts
from .connections import FIRM, FULL, GRAPH, _graph
from .evidence import JOIN
from .registry import CALLS, CONTACTS, HOLDINGS, query
from .texts import _MENTIONS, _mentions


@query("SELECT o_orderkey::VARCHAR AS txn_ref, 'C' || o_custkey AS from_account, o_orderstatus AS to_account, round(o_totalprice, 2) AS amount, date_trunc('second', o_orderdate) AS timestamp FROM orders")
def src_csv_records(spark, sf_dir):
    """Orders written as CSV under other headers and read back as transactions."""
    import uuid

    path = f"{checkpoint_root(spark)}/ledgerlens/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Transaction_ID"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("debit_account"), F.col("o_orderstatus").alias("TO"),
        F.round("o_totalprice", 2).cast("string").alias("Value"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("txn_date"),
    )
    R.write_records(rows, path)
    return R.read_records(spark, path, "transactions")


@query(f"{ENVELOPE} SELECT key, kind, row_number() OVER (ORDER BY key DESC) AS place FROM alerts WHERE severity = 'high' AND kind <> 'COMM_BURST'")
def list_alerts(spark, sf_dir):
    page = _alerts(spark, sf_dir).where("severity = 'high' and kind <> 'COMM_BURST'")
    return placed(page.select("key", "kind"), [F.desc("key")])


@query(f"WITH {CALLS}, {CONTACTS}, parts AS (SELECT src, dst, 'ASSOCIATES_WITH' AS rel_type FROM contacts UNION ALL SELECT caller, callee, 'CALLED' FROM calls) SELECT rel_type, count(*) AS n FROM parts WHERE rel_type IN ('CALLED') AND src % 3 IN (0, 1) AND dst % 3 IN (0, 1) GROUP BY 1")
def graph_filtered(spark, sf_dir):
    """Relations of some types between nodes of some types (remainders stand for types)."""
    parts = contacts(spark, sf_dir).select("src", "dst", F.lit("ASSOCIATES_WITH").alias("rel_type")).unionByName(calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLED").alias("rel_type")))
    kept = parts.where(F.col("rel_type").isin("CALLED") & (F.col("src") % 3).isin(0, 1) & (F.col("dst") % 3).isin(0, 1))
    return kept.groupBy("rel_type").agg(F.count("*").alias("n"))


@query("SELECT event_id AS key, user_id AS subject FROM events WHERE event_type = 'click' AND value < 5")
def denials(spark, sf_dir):
    """Statements of negative polarity (clicks of small value) of one kind."""
    e = table(spark, sf_dir, "events").withColumn("polarity", F.when(F.col("value") < 5, -1).otherwise(1))
    return e.where("polarity = -1 and event_type = 'click'").select(F.col("event_id").alias("key"), F.col("user_id").alias("subject"))


@query("WITH p AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 50 = 7) SELECT o_orderkey AS key FROM orders JOIN p USING (o_orderpriority, o_custkey)")
def passage_members(spark, sf_dir):
    """All statements of a passage (customer and priority) of which one was asked for."""
    o = table(spark, sf_dir, "orders")
    asked = o.where("o_orderkey % 50 = 7").select("o_orderpriority", "o_custkey").distinct()
    return o.join(asked, ["o_orderpriority", "o_custkey"], "left_semi").select(F.col("o_orderkey").alias("key"))


@query()
def entity_sentences(spark, sf_dir):
    """Identifiers and listed words with the sentence that holds them."""
    docs = table(spark, sf_dir, "documents")
    return X.in_sentences(X.entities(docs), X.sentence_spans(docs))


@query(f"""WITH {_MENTIONS}, j AS (SELECT DISTINCT a.doc_id, lower(a.surface) AS src, lower(b.surface) AS dst, a.sentence_no FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND a.start < b.start AND lower(a.surface) <> lower(b.surface))
SELECT doc_id, src, dst, 'ASSOCIATES_WITH' AS rel_type, count(DISTINCT sentence_no) AS weight, array_to_string(list_sort(list(sentence_no))[1:5], ' | ') AS evidence FROM j GROUP BY 1, 2, 3""")
def doc_relations(spark, sf_dir):
    """Relations of a document; the evidence is the sentences' numbers."""
    pairs = X.cooccurrence(_mentions(spark, sf_dir)).select("doc_id", "sentence_no", F.col("left").alias("src"), F.col("right").alias("dst"), F.lit("ASSOCIATES_WITH").alias("rel_type"), F.col("sentence_no").cast("string").alias("snippet"))
    return X.document_relations(pairs)


@query("SELECT 'P:K' || (o_custkey % 3) || ':' || o_custkey AS person, count(*) AS mentions, count(DISTINCT o_orderpriority) AS surfaces, min(o_orderpriority) AS least FROM orders GROUP BY o_custkey")
def people(spark, sf_dir):
    k = F.col("o_custkey")
    person = S.person_key(F.concat(F.lit("K"), (k % 3).cast("string")), k.cast("string"))
    return table(spark, sf_dir, "orders").groupBy(person.alias("person")).agg(F.count("*").alias("mentions"), F.countDistinct("o_orderpriority").alias("surfaces"), F.min("o_orderpriority").alias("least"))


@query("SELECT 'sf-' || substr(sha256(source), 1, 16) AS family, min(doc_id) AS origin, count(*) AS statements, array_to_string(list_sort(list_distinct(list(lang))), ',') AS cases FROM documents GROUP BY source")
def source_families(spark, sf_dir):
    family = F.concat(F.lit("sf-"), S.short_hash(16, F.col("source")))
    return table(spark, sf_dir, "documents").groupBy(family.alias("family")).agg(F.min("doc_id").alias("origin"), F.count("*").alias("statements"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("cases"))


@query(f"WITH {CALLS}, {HOLDINGS} SELECT 'events' AS what, count(*) AS n FROM calls UNION ALL SELECT 'holdings', count(*) FROM holdings UNION ALL SELECT 'people', count(DISTINCT person) FROM holdings UNION ALL SELECT 'identifiers', count(DISTINCT identifier) FROM holdings")
def workspace_counts(spark, sf_dir):
    h = holdings(spark, sf_dir)
    one = lambda df, what, n: df.agg(n.alias("n")).select(F.lit(what).alias("what"), "n")
    parts = [one(calls(spark, sf_dir), "events", F.count("*")), one(h, "holdings", F.count("*")), one(h, "people", F.countDistinct("person")), one(h, "identifiers", F.countDistinct("identifier"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_HELD = """held AS (SELECT event_id, caller, ts, person, holding, kind FROM calls c JOIN holdings a ON a.identifier = c.caller AND (a.starts IS NULL OR a.starts <= c.ts) AND (a.ends IS NULL OR c.ts < a.ends)),
clash AS (SELECT event_id FROM held GROUP BY 1 HAVING count(DISTINCT person) > 1)"""


def _held(spark, sf_dir):
    h = holdings(spark, sf_dir).withColumnRenamed("identifier", "caller")
    held = calls(spark, sf_dir).join(h, "caller").where(E.covers(F.col("starts"), F.col("ends"), F.col("ts"))).select("event_id", "caller", "ts", "person", "holding", "kind")
    return held, E.conflicts(calls(spark, sf_dir), holdings(spark, sf_dir)).select("event_id")


@query(f"WITH {CALLS}, {HOLDINGS}, {_HELD} SELECT DISTINCT holding FROM held JOIN clash USING (event_id) WHERE kind = 'claim'")
def contested_items(spark, sf_dir):
    """Claims that a record contradicts at some event."""
    held, clash = _held(spark, sf_dir)
    return held.where("kind = 'claim'").join(clash, "event_id", "left_semi").select("holding").distinct()


@query(f"""WITH {CALLS}, {HOLDINGS}, {_HELD}, s AS (SELECT event_id, caller AS identifier, ts, string_agg(DISTINCT person::VARCHAR, ',' ORDER BY person::VARCHAR) AS people FROM held JOIN clash USING (event_id) GROUP BY 1, 2, 3)
SELECT identifier, people, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2""")
def contrary(spark, sf_dir):
    """Conflicts by number and people, with their span."""
    held, clash = _held(spark, sf_dir)
    who = F.array_join(F.array_sort(F.collect_set(F.col("person").cast("string"))), ",")
    s = held.join(clash, "event_id", "left_semi").groupBy("event_id", F.col("caller").alias("identifier"), "ts").agg(who.alias("people"))
    return s.groupBy("identifier", "people").agg(F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(f"WITH {CALLS}, {HOLDINGS}, {JOIN} SELECT event_id, min(ts) AS ts, count(*) AS readings FROM (SELECT DISTINCT event_id, ts, person_a, person_b FROM j) GROUP BY 1")
def timeline(spark, sf_dir):
    """Events with how many different readings (pairs of people) they have."""
    j = E.temporal_holder_join(calls(spark, sf_dir), holdings(spark, sf_dir))
    return j.select("event_id", "ts", "person_a", "person_b").distinct().groupBy("event_id").agg(F.min("ts").alias("ts"), F.count("*").alias("readings"))


@query(f"""WITH {CALLS}, {HOLDINGS}, {JOIN}, k AS (SELECT j.*, h.kind AS ka, g.kind AS kb FROM j JOIN holdings h ON h.holding = holding_a JOIN holdings g ON g.holding = holding_b)
SELECT person_a AS src, person_b AS dst, count(*) AS derivations FROM k WHERE ka <> 'claim' AND kb <> 'claim' AND event_id % 3 <> 0 GROUP BY 1, 2""")
def derive_edges(spark, sf_dir):
    """Edges derived anew under a scenario: claims and a third of the events are withdrawn."""
    return E.call_edges(calls(spark, sf_dir).where("event_id % 3 <> 0"), holdings(spark, sf_dir).where("kind <> 'claim'")).select("src", "dst", "derivations")


@query(f"WITH {CALLS}, {HOLDINGS} SELECT least(a.person, b.person) AS a, greatest(a.person, b.person) AS b, count(DISTINCT event_id) AS events FROM calls c JOIN holdings a ON a.identifier = c.caller JOIN holdings b ON b.identifier = c.callee WHERE a.person <> b.person GROUP BY 1, 2")
def naive_findings(spark, sf_dir):
    """Connections if holdings were timeless: everyone who ever held a number answers for all its calls."""
    h = holdings(spark, sf_dir).select("holding", "person", "identifier", F.lit(None).cast("timestamp").alias("starts"), F.lit(None).cast("timestamp").alias("ends"))
    j = E.temporal_holder_join(calls(spark, sf_dir), h)
    return j.groupBy(F.least("person_a", "person_b").alias("a"), F.greatest("person_a", "person_b").alias("b")).agg(F.countDistinct("event_id").alias("events"))


@query(f"""WITH RECURSIVE {GRAPH}, {FULL}, {FIRM}, r AS (SELECT p.a, p.b, CASE WHEN firm IS NULL THEN 'lead' ELSE 'supported' END AS status, coalesce(firm, distance) AS distance FROM pairs p JOIN dist USING (a, b) LEFT JOIN firm USING (a, b))
SELECT a, b, row_number() OVER (ORDER BY CASE status WHEN 'lead' THEN 0 WHEN 'supported' THEN 1 ELSE 2 END, distance, a, b) AS place FROM r""")
def finding_queue(spark, sf_dir):
    """Findings in order: leads, then supported ones, the nearest first."""
    edges, pairs, hubs = _graph(spark, sf_dir)
    order = [F.when(F.col("status") == "lead", 0).otherwise(1), F.col("distance"), F.col("a"), F.col("b")]
    return placed(C.findings(edges, pairs, hubs), order).select("a", "b", "place")


@query()
def alternatives(spark, sf_dir):
    """What accepting or rejecting each provisional identity would change."""
    edges, pairs, hubs = _graph(spark, sf_dir)
    return C.decision_effects(edges, pairs, hubs)


@query(f"WITH {CALLS}, t AS (SELECT DISTINCT caller AS node FROM calls WHERE event_id % 40 = 3), f AS (SELECT DISTINCT caller AS a, callee AS b FROM calls WHERE event_id % 5 = 0) SELECT a, b, count(*) AS tasks FROM f JOIN t ON t.node IN (a, b) GROUP BY 1, 2")
def finding_tasks(spark, sf_dir):
    """Findings that share evidence with some task."""
    c = calls(spark, sf_dir)
    tasks = c.where("event_id % 40 = 3").select(F.col("caller").alias("atom")).distinct()
    found = c.where("event_id % 5 = 0").select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    atoms = found.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("atom"))
    return atoms.join(tasks, "atom").groupBy("a", "b").agg(F.count("*").alias("tasks"))


@query("SELECT doc_id, 'phone' AS source FROM documents WHERE regexp_matches(text, '(?:\\+91[\\-\\s]?)?[6-9]\\d{9}\\b') UNION ALL SELECT doc_id, 'account' FROM documents WHERE regexp_matches(text, '\\b\\d{11,18}\\b')")
def ner_candidates(spark, sf_dir):
    """Candidates of two generators together: documents with phones, documents with accounts."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.col("text").rlike(X.PHONE)).select("doc_id", F.lit("phone").alias("source")).unionByName(docs.where(F.col("text").rlike(X.BANK_ACCOUNT)).select("doc_id", F.lit("account").alias("source")))


@query("WITH o AS (SELECT o_custkey AS finding, o_orderpriority AS explanation, o_orderstatus AS outcome FROM orders), n AS (SELECT finding, count(DISTINCT outcome) AS k FROM o GROUP BY 1), e AS (SELECT finding, explanation, count(DISTINCT outcome) AS k FROM o GROUP BY 1, 2) SELECT finding, count(*) AS changed FROM e JOIN n USING (finding) WHERE e.k < n.k GROUP BY 1")
def explanation_changes(spark, sf_dir):
    """Explanations (priorities) that not all outcomes (statuses) of a finding (customer) have."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("finding"), F.col("o_orderpriority").alias("explanation"), F.col("o_orderstatus").alias("outcome"))
    n = o.groupBy("finding").agg(F.countDistinct("outcome").alias("of"))
    e = o.groupBy("finding", "explanation").agg(F.countDistinct("outcome").alias("k"))
    return e.join(n, "finding").where("k < of").groupBy("finding").agg(F.count("*").alias("changed"))


@query(f"WITH {CALLS} SELECT event_id, CASE WHEN caller % 4 = 0 AND callee % 4 = 0 THEN '' WHEN caller % 4 = 0 THEN callee::VARCHAR WHEN callee % 4 = 0 OR caller = callee THEN caller::VARCHAR ELSE caller || ',' || callee END AS people FROM calls")
def alert_entities(spark, sf_dir):
    """Distinct people of an alert in order, unknown ones (every fourth) dropped."""
    known = lambda c: F.when(F.col(c) % 4 != 0, F.col(c).cast("string"))
    return calls(spark, sf_dir).select("event_id", F.array_join(F.array_distinct(F.array_compact(F.array(known("caller"), known("callee")))), ",").alias("people"))


@query("SELECT o_orderkey AS id, date_trunc('day', o_orderdate) - INTERVAL 330 MINUTE AS moment FROM orders")
def fn_parse_day(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.parse_day(text).alias("moment"))


@query(f"WITH {CALLS} SELECT event_id, caller || ' called ' || callee || ' on ' || strftime(ts + INTERVAL 330 MINUTE, '%d/%m/%Y') || CASE WHEN duration_sec > 30 THEN ' for ' || duration_sec || 's' ELSE '' END AS summary FROM calls")
def statement_summary(spark, sf_dir):
    """A sentence for each contact, with the Indian date."""
    day = F.date_format(F.from_utc_timestamp("ts", S.IST), "dd/MM/yyyy")
    tail = F.when(F.col("duration_sec") > 30, F.concat(F.lit(" for "), F.col("duration_sec").cast("string"), F.lit("s"))).otherwise("")
    return calls(spark, sf_dir).select("event_id", F.concat(F.col("caller").cast("string"), F.lit(" called "), F.col("callee").cast("string"), F.lit(" on "), day, tail).alias("summary"))


@query("SELECT user_id, count(*) AS alerts, max(json_extract_string(props, '$.k')::BIGINT) AS top FROM events GROUP BY 1")
def alert_evidence(spark, sf_dir):
    """A field of the evidence's JSON, through a variant."""
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("alerts"), F.max(k).alias("top"))


@query("SELECT c_custkey AS doc_id, 'Person ' || chr((65 + c_custkey % 26)::INT) || 'x' AS person, CASE WHEN c_custkey % 2 = 0 THEN 'the ' || c_mktsegment ELSE 'Raja' END AS alias FROM customer WHERE c_custkey % 3 <> 0")
def alias_links(spark, sf_dir):
    """Sentences made of customers: 'Person Ax alias "the MACHINERY"' or 'Person Ax aka Raja'."""
    k = F.col("c_custkey")
    who = F.concat(F.lit("then Person "), F.chr(k % 26 + 65), F.lit("x"))
    text = F.when(k % 3 == 0, F.concat(who, F.lit(" alias nobody"))).when(k % 2 == 0, F.concat(who, F.lit(" alias 'the "), "c_mktsegment", F.lit("' fled."))).otherwise(F.concat(who, F.lit(" AKA Raja went")))
    return X.alias_links(table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text")))


@query(f"WITH w AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_replace(x, '^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+$', '', 'g')) AS ws FROM documents), n AS (SELECT DISTINCT ws[1] || ' ' || ws[2] AS surface FROM w WHERE length(ws[1] || ' ' || ws[2]) >= 3), t AS (SELECT doc_id, unnest(range(len(ws))) AS place, ws FROM w) SELECT doc_id, place::INT AS place, surface FROM t JOIN n ON surface = ws[place + 1] || ' ' || ws[place + 2] WHERE place + 2 <= len(ws)")
def gazetteer_hits(spark, sf_dir):
    """Where the first two words of any text occur in all of them."""
    docs = table(spark, sf_dir, "documents")
    words = X.bare_words(F.col("text"), 2)
    names = docs.select(F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1))).alias("surface")).where("surface is not null")
    return X.gazetteer_hits(docs, names, 2, fewest=2)


@query(f"WITH {_MENTIONS} SELECT doc_id, surface, min(sentence_no * 10000 + start)::BIGINT AS first_at, count(*) AS mentions, row_number() OVER (PARTITION BY doc_id ORDER BY min(sentence_no * 10000 + start), surface) AS place FROM m GROUP BY 1, 2")
def document_entities(spark, sf_dir):
    m = _mentions(spark, sf_dir).select("doc_id", "surface", (F.col("sentence_no").cast("long") * 10000 + F.col("start")).alias("start"))
    return X.first_appearances(m)


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, (o_orderkey % 97)::INT AS a, (o_orderkey % 97 + 1 + o_orderkey % 13)::INT AS b FROM orders), o AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS n FROM s),
w(doc_id, n, a, b, kept, cursor_) AS (SELECT doc_id, n, a, b, true, b FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, o.a, o.b, o.a >= cursor_, CASE WHEN o.a >= cursor_ THEN o.b ELSE cursor_ END FROM w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1)
SELECT doc_id, a AS start, b AS "end" FROM w WHERE kept""")
def highlight_spans(spark, sf_dir):
    k = F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 97).cast("int").alias("start"), (k % 97 + 1 + k % 13).cast("int").alias("end"))
    return X.highlight_spans(spans)


@query()
def eigenvector(spark, sf_dir):
    return G.eigenvector(stored(contacts(spark, sf_dir), "contacts")).select("id", F.round("eigenvector", 6).alias("eigenvector"))


@query()
def graph_payload(spark, sf_dir):
    return G.graph_payload(stored(contacts(spark, sf_dir), "contacts"))


@query("SELECT event_type AS kind, count(*) AS kept FROM events WHERE user_id % 10 <> 4 OR event_type <> 'view' GROUP BY 1")
def purge_vision_run(spark, sf_dir):
    """Rows of all kinds but those of one kind that belong to the purged runs (users)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("run"))
    gone = e.where("kind = 'view' and run % 10 = 4").select("event_id")
    return e.join(gone, "event_id", "left_anti").groupBy("kind").agg(F.count("*").alias("kept"))


@query("SELECT user_id AS caller, ts::DATE AS day, count(*) AS calls FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    """Tumbling day windows, as the streaming form computes them."""
    from ..streaming.detect import daily_counts

    c = calls(spark, sf_dir).select("caller", F.col("caller").alias("callee"), "ts", "duration_sec")
    return daily_counts(c).select(F.col("a").alias("caller"), "day", "calls")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id AS caller, min(ts) AS begun, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS calls FROM g GROUP BY user_id, s""")
def session_counts(spark, sf_dir):
    """Session windows with a gap of half an hour."""
    from ..streaming.detect import sessions

    return sessions(calls(spark, sf_dir))


@query("""WITH t AS (SELECT sha256('"c_custkey":' || c_custkey) AS name, sha256('"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey) AS digest FROM customer),
rows_ AS (SELECT substr(name, 1, 3) AS bucket, ('0x' || substr(digest, 1, 15))::BIGINT::HUGEINT AS a, ('0x' || substr(digest, 16, 15))::BIGINT::HUGEINT AS b FROM t)
SELECT substr(bucket, 1, len) AS node, count(*) AS n, sha256(count(*) || '|' || sum(a) || '|' || sum(b)) AS digest FROM rows_, range(4) l(len) GROUP BY 1""")
def corpus_fingerprint(spark, sf_dir):
    """Digests of the customers by a tree over their keys' hashes; the node without digits is the whole table's."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return fingerprint.digests(rows, ["c_custkey"])
