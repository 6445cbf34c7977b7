"""Record and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import text as X
from ..sources import records as R
from ..sources.adapters import table
from ..sources.exact import exact_rows, raw_lines
from ..sources.storage import checkpoint_root
from .registry import query


@query("SELECT o_orderkey::VARCHAR AS txn_ref, 'C' || o_custkey AS from_account, o_orderpriority AS to_account, o_totalprice AS amount, o_orderdate AS timestamp FROM orders")
def src_header_alias(spark, sf_dir):
    """Orders under other headers, as text: the aliases resolve and the cells are coerced."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias(" Txn_ID "), F.concat(F.lit("  C"), F.col("o_custkey").cast("string")).alias("Sender"), F.col("o_orderpriority").alias("beneficiary"),
        F.col("o_totalprice").cast("string").alias("AMT"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Date"),
    )
    return R.coerce(raw, "transactions")


@query("SELECT (6000000000 + c_custkey)::VARCHAR AS identifier, c_name AS owner_name, DATE '2024-01-01' + (c_custkey % 60)::INT AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-03-31' END AS valid_to, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey END AS registered_mobile FROM customer")
def src_extra_columns(spark, sf_dir):
    """Subscribers with the columns that statements need, days written in two ways; each header serves one name."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    raw = table(spark, sf_dir, "customer").select(
        (k + 6000000000).cast("string").alias("Number"), F.col("c_name").alias("Name"), F.when(k % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Activation_Date"),
        F.when(k % 2 == 0, "31.03.2024").otherwise("open").alias("To_Date"), F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("Mobile"),
    )
    return R.coerce(raw, "subscriber_records", exclusive=True)


@query("""WITH c AS (SELECT c_custkey // 500 AS path, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) AS number FROM customer)
SELECT path::VARCHAR AS path, number, 1 + 2 * number AS first_line, k || ',"a' || chr(10) || 'b",2024' AS exact, k::VARCHAR AS caller, 'a' || chr(10) || 'b' AS callee FROM c""")
def src_exact_rows(spark, sf_dir):
    """Files of customers by the five hundred, a blank line after the header and a cell of two lines in each row: rows as they stand."""
    k = F.col("c_custkey")
    of = F.floor(k / 500).cast("string").alias("path")
    rows = table(spark, sf_dir, "customer").select(of, k, F.concat(k.cast("string"), F.lit(',"a\nb",2024')).alias("value"))
    heads = rows.select("path").distinct().select("path", F.lit(-1).cast("long").alias("c_custkey"), F.lit("A_Party,B_Party,Date\n").alias("value"))
    place = f"{checkpoint_root(spark)}/ledgerlens/exact-{uuid.uuid4().hex}"
    whole = rows.unionByName(heads).repartition("path").sortWithinPartitions("path", "c_custkey")
    whole.select("path", "value").write.partitionBy("path").text(place)
    found = exact_rows(raw_lines(spark, place), "call_records")
    return found.select(F.regexp_extract("path", "path=([0-9]+)", 1).alias("path"), "number", "first_line", "exact", F.col("fields.caller").alias("caller"), F.col("fields.callee").alias("callee"))


_RAW_CALLS = """raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id::VARCHAR END AS caller, CASE WHEN event_id % 13 = 0 THEN '  ' ELSE event_type END AS callee,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS t FROM events)"""


def _raw_calls(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(k % 11 == 0, None).otherwise(F.col("user_id").cast("string")).alias("a_party"), F.when(k % 13 == 0, "  ").otherwise(F.col("event_type")).alias("b_party"),
        F.when(k % 17 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("call_time"), F.when(k % 5 == 0, "x").otherwise("60").alias("secs"),
    )


@query(f"WITH {_RAW_CALLS} SELECT caller, callee, count(*) AS n, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 60 END)::DOUBLE AS seconds FROM raw WHERE caller IS NOT NULL AND trim(callee) <> '' AND t IS NOT NULL GROUP BY 1, 2")
def src_bad_rows(spark, sf_dir):
    """Calls with all that is required, after the others are dropped."""
    good, _ = R.split_bad(R.coerce(_raw_calls(spark, sf_dir), "call_records"), "call_records")
    return good.groupBy("caller", "callee").agg(F.count("*").alias("n"), F.sum(F.coalesce("duration_sec", F.lit(0.0))).alias("seconds"))


@query(f"WITH {_RAW_CALLS} SELECT CASE WHEN caller IS NULL THEN 'no caller' WHEN trim(callee) = '' THEN 'no callee' ELSE 'no timestamp' END AS reason, count(*) AS n FROM raw WHERE caller IS NULL OR trim(callee) = '' OR t IS NULL GROUP BY 1")
def src_bad_rows_kept(spark, sf_dir):
    _, bad = R.split_bad(R.coerce(_raw_calls(spark, sf_dir), "call_records"), "call_records")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?:\\+91[\\-\\s]?)?[6-9]\\d{9}\\b'))::BIGINT AS phones, len(regexp_extract_all(text, '\\b\\d{11,18}\\b'))::BIGINT AS accounts,
len(regexp_extract_all(text, '\\b[A-Z]{2}[\\s\\-]?\\d{1,2}[\\s\\-]?[A-Z]{1,3}[\\s\\-]?\\d{4}\\b'))::BIGINT AS vehicles, len(regexp_extract_all(text, '\\b[A-Z]{4}0[A-Z0-9]{6}\\b'))::BIGINT AS ifsc,
len(regexp_extract_all(text, '(?i)\\bFIR\\s*(?:No\\.?|Number)?\\s*[:\\-]?\\s*\\d+/\\d{2,4}\\b'))::BIGINT AS firs FROM documents""")
def ner_rule_counts(spark, sf_dir):
    return X.rule_counts(table(spark, sf_dir, "documents"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)\\b(?:methamphetamine|brown sugar|contraband|mephedrone|cocaine|hashish|charas|heroin|ganja|opium)\\b'))::BIGINT AS drugs,
len(regexp_extract_all(text, '(?i)\\b(?:country-made pistol|ammunition|cartridges|revolver|firearm|pistol|ak-47|rifle)\\b'))::BIGINT AS weapons FROM conversations""")
def ner_lexicon(spark, sf_dir):
    """Over conversations; each turn is a document."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return X.lexicon_counts(turns).select("doc_id.conv_id", "doc_id.turn", "drugs", "weapons")


_SENTENCES = """s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM documents),
sent AS (SELECT doc_id, unnest(range(len(xs))) AS sentence_no, unnest(xs) AS sentence FROM s)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, sentence_no::INT AS sentence_no, sentence FROM sent")
def sentences(spark, sf_dir):
    return X.sentences(table(spark, sf_dir, "documents"))


_CUES = [(r, c) for r, cues in X.CUES.items() for c in cues]
_CUE_SQL = "CASE " + " ".join(f"WHEN p = {i} THEN '{r}'" for i, (r, _) in enumerate(_CUES)) + " END"
_PLACES = "[" + ", ".join(f"CASE WHEN strpos(low, '{c}') > 0 THEN strpos(low, '{c}') * 1000 + {i} ELSE 999999999 END" for i, (_, c) in enumerate(_CUES)) + "]"


@query(f"WITH t AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), q AS (SELECT conv_id, turn, list_min({_PLACES}) AS m FROM t), r AS (SELECT conv_id, turn, m % 1000 AS p, m FROM q) SELECT conv_id, turn, CASE WHEN m < 999999999 THEN {_CUE_SQL} END AS rel FROM r")
def relation_cues(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_cue(F.col("text")).alias("rel"))


_TYPES = "['PERSON', 'ORG', 'LOCATION', 'PHONE', 'BANK_ACCOUNT', 'VEHICLE', 'WEAPON', 'DRUG']"


@query(f"""WITH p AS (SELECT conv_id, turn, {_TYPES}[conv_id % 8 + 1] AS a, {_TYPES}[(conv_id // 8 + turn) % 8 + 1] AS b FROM conversations) SELECT conv_id, turn, a, b,
CASE WHEN (a IN ('PHONE', 'BANK_ACCOUNT', 'VEHICLE') AND b IN ('PERSON', 'ORG')) OR (b IN ('PHONE', 'BANK_ACCOUNT', 'VEHICLE') AND a IN ('PERSON', 'ORG')) THEN 'OWNS'
WHEN a IN ('PERSON', 'PHONE') AND b IN ('PERSON', 'PHONE') THEN 'CALLED'
WHEN (a = 'LOCATION' AND b = 'PERSON') OR (b = 'LOCATION' AND a = 'PERSON') THEN 'LOCATED_AT'
WHEN (a = 'PERSON' AND b = 'ORG') OR (a = 'ORG' AND b = 'PERSON') THEN 'MEMBER_OF' ELSE 'ASSOCIATES_WITH' END AS rel FROM p""")
def relation_types(spark, sf_dir):
    """Turns whose ids name two types, with 'called' between the names and first in the sentence: the cue holds where the types allow it, else the types decide."""
    types = F.array(*(F.lit(t) for t in ("PERSON", "ORG", "LOCATION", "PHONE", "BANK_ACCOUNT", "VEHICLE", "WEAPON", "DRUG")))
    pick = lambda n: F.get(types, (n % 8).cast("int"))
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", pick(F.col("conv_id")).alias("a"), pick(F.floor(F.col("conv_id") / 8) + F.col("turn")).alias("b"))
    return pairs.select("conv_id", "turn", "a", "b", X.relation_type(F.col("a"), F.col("b"), F.lit(" Called "), F.lit("x called y near z")).alias("rel"))


_MENTIONS = f"{_SENTENCES}, m AS (SELECT doc_id, sentence_no, i AS start, w AS surface FROM (SELECT doc_id, sentence_no, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, sentence_no, string_split(sentence, ' ') AS ws FROM sent)) WHERE regexp_matches(w, '^[A-Z][a-z]{{5,}}'))"


def _mentions(spark, sf_dir):
    s = X.sentences(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "sentence_no", F.posexplode(F.split("sentence", " ")).alias("start", "surface")).where(F.col("surface").rlike("^[A-Z][a-z]{5,}"))


@query(f'WITH {_MENTIONS} SELECT a.surface AS "left", b.surface AS "right", count(*) AS sentences FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.sentence_no = b.sentence_no AND a.start < b.start AND lower(a.surface) <> lower(b.surface) GROUP BY 1, 2')
def cooccurrence(spark, sf_dir):
    """Capitalised words of six letters or more that share a sentence."""
    return X.cooccurrence(_mentions(spark, sf_dir)).groupBy("left", "right").agg(F.count("*").alias("sentences"))


@query(f"""WITH {_MENTIONS}, c AS (SELECT lower(left(surface, 4)) AS cluster, surface, count(*) AS n FROM m GROUP BY 1, 2)
SELECT cluster, surface AS canonical, mentions, surfaces FROM (SELECT *, sum(n) OVER (PARTITION BY cluster)::BIGINT AS mentions, count(*) OVER (PARTITION BY cluster) AS surfaces,
  row_number() OVER (PARTITION BY cluster ORDER BY n DESC, strpos(surface, ',') > 0, length(surface) DESC, surface DESC) AS p FROM c) WHERE p = 1""")
def canonical_names(spark, sf_dir):
    """The same words, clustered by their first four letters."""
    m = _mentions(spark, sf_dir)
    return X.canonical_names(m.select(F.lower(F.substring("surface", 1, 4)).alias("cluster"), "surface"))


@query(f"SELECT surface FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS surface FROM documents) WHERE length(lower(regexp_replace(trim(surface), '^[.,;:\"'']+|[.,;:\"'']+$', '', 'g'))) < 2 OR lower(regexp_replace(trim(surface), '^[.,;:\"'']+|[.,;:\"'']+$', '', 'g')) IN ({', '.join(repr(w) for w in X.BLOCKED)}) OR NOT regexp_matches(surface, '[\\p{{L}}\\p{{N}}]')")
def ner_noise(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("surface")).distinct()
    return words.where(X.is_noise(F.col("surface")))


@query()
def ner_entities(spark, sf_dir):
    """Entities by rule, list and gazetteer (the nations' names)."""
    names = [(r.n_name, "LOCATION") for r in table(spark, sf_dir, "nation").collect()]
    return X.entities(table(spark, sf_dir, "documents"), names)


@query("""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
ids AS (SELECT doc_id, i, w FROM w WHERE regexp_matches(w, '[0-9]')), ppl AS (SELECT doc_id, i, w FROM w WHERE regexp_matches(w, '^[A-Z][a-z]{4,}$')),
j AS (SELECT ids.doc_id, ids.i AS i_start, ids.w AS identifier, ppl.w AS person, ppl.i AS ps, CASE WHEN ppl.i > ids.i THEN ppl.i - ids.i - 1 ELSE ids.i - ppl.i - 1 END AS gap, (ppl.i > ids.i)::INT AS r FROM ids JOIN ppl ON ids.doc_id = ppl.doc_id AND ids.i <> ppl.i)
SELECT doc_id, i_start::INT AS i_start, identifier, person, gap::INT AS gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i_start ORDER BY gap, r, ps) AS p FROM j WHERE gap <= 60) WHERE p = 1""")
def attach_identifiers(spark, sf_dir):
    """Words with digits and the nearest capitalised word; places count words."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("start", "surface")).withColumn("end", F.col("start") + 1).select("doc_id", "start", "end", "surface")
    return X.attach(w.where(F.col("surface").rlike("[0-9]")), w.where(F.col("surface").rlike("^[A-Z][a-z]{4,}$")))


@query("SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS label FROM supplier WHERE s_name ILIKE '%7%' UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_name ILIKE '%77%'")
def search(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%7%")).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return s.unionByName(table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%77%")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label")))


@query("SELECT n_name AS case_name, count(DISTINCT c_custkey) AS entities, count(o_orderkey) AS records, count(*) FILTER (o_orderstatus = 'O') AS open_records FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def case_stats(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey, "left")
    return j.groupBy(F.col("n_name").alias("case_name")).agg(F.countDistinct("c_custkey").alias("entities"), F.count("o_orderkey").alias("records"), F.count_if(F.col("o_orderstatus") == "O").alias("open_records"))


@query("SELECT c_mktsegment AS entity_type, c_name AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS place FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def list_entities(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return rows.select(F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"), F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_name", "c_custkey")).alias("place"))
