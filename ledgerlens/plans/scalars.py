"""Queries of the scalar rules, over columns of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.adapters import table
from .registry import query

_HONORIFIC = "shri|smt|mr|mrs|ms|dr|sh|md|mohd"
#: Names with honorifics, punctuation and blanks, made of part names and keys.
NAMES_SQL = "names AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'smt ' WHEN 2 THEN '' ELSE 'DR.  ' END || p_name || CASE p_partkey % 3 WHEN 0 THEN ', ' || p_brand WHEN 1 THEN '.' ELSE '' END AS name FROM part)"


def _names(spark, sf_dir):
    i = F.col("p_partkey") % 4
    j = F.col("p_partkey") % 3
    front = F.when(i == 0, "Mr. ").when(i == 1, "smt ").when(i == 2, "").otherwise("DR.  ")
    back = F.when(j == 0, F.concat(F.lit(", "), "p_brand")).when(j == 1, ".").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(front, "p_name", back).alias("name"))


#: Phone- and account-like values made of order keys.
VALUES_SQL = """vals AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '+91-' || (6000000000 + o_orderkey * 7919 % 3999999999) WHEN 1 THEN '0' || (6000000000 + o_orderkey * 7919 % 3999999999)
  WHEN 2 THEN ' ' || (60000000000 + o_orderkey * 104729) ELSE 'ab-' || o_orderkey || '/x. 9' END AS value FROM orders)"""


def _values(spark, sf_dir):
    k = F.col("o_orderkey")
    phone = (k * 7919 % 3999999999 + 6000000000).cast("string")
    value = F.when(k % 4 == 0, F.concat(F.lit("+91-"), phone)).when(k % 4 == 1, F.concat(F.lit("0"), phone)).when(k % 4 == 2, F.concat(F.lit(" "), (k * 104729 + 60000000000).cast("string"))).otherwise(F.concat(F.lit("ab-"), k.cast("string"), F.lit("/x. 9")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), value.alias("value"))


_NORM_NAME = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '(?i)^({_HONORIFIC})\\.?\\s+', ''), '[.,;:\"'']', '', 'g'), '\\s+', ' ', 'g')))"


@query(f"WITH {NAMES_SQL} SELECT id, {_NORM_NAME} AS name FROM names")
def fn_normalize_name(spark, sf_dir):
    return _names(spark, sf_dir).select("id", S.normalize_name(F.col("name")).alias("name"))


@query(f"WITH {VALUES_SQL}, b AS (SELECT id, upper(regexp_replace(value, '[ \\-+()]', '', 'g')) AS v FROM vals) SELECT id, CASE WHEN length(v) = 12 AND v LIKE '91%' THEN substr(v, 3) ELSE v END AS value FROM b")
def fn_normalize_identifier(spark, sf_dir):
    return _values(spark, sf_dir).select("id", S.normalize_identifier(F.col("value")).alias("value"))


_PHONE = "CASE WHEN length(d) = 12 AND d LIKE '91%' THEN substr(d, 3) WHEN length(d) = 11 AND d LIKE '0%' THEN substr(d, 2) ELSE d END"
_DIGITS = "d AS (SELECT id, value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM vals)"


@query(f"WITH {VALUES_SQL}, {_DIGITS} SELECT id, {_PHONE} AS value FROM d")
def fn_normalize_phone(spark, sf_dir):
    return _values(spark, sf_dir).select("id", S.normalize_phone(F.col("value")).alias("value"))


@query(f"WITH {VALUES_SQL} SELECT id, upper(regexp_replace(value, '[ \\-./]', '', 'g')) AS value FROM vals")
def fn_normalize_account(spark, sf_dir):
    return _values(spark, sf_dir).select("id", S.normalize_account(F.col("value")).alias("value"))


@query(f"WITH {VALUES_SQL}, {_DIGITS} SELECT id, CASE WHEN regexp_matches(d, '^[6-9][0-9]{{9}}$') THEN 'PHONE' ELSE 'ACCOUNT' END AS kind FROM d")
def fn_identifier_type(spark, sf_dir):
    return _values(spark, sf_dir).select("id", S.identifier_type(F.col("value")).alias("kind"))


@query(f"""WITH {VALUES_SQL}, {_DIGITS} SELECT id, CASE WHEN id % 4 < 2 THEN 'PHONE:' || {_PHONE} ELSE 'ACCOUNT:' || upper(regexp_replace(value, '[ \\-./]', '', 'g')) END AS key FROM d""")
def fn_keys(spark, sf_dir):
    kind = F.when(F.col("id") % 4 < 2, "PHONE").otherwise("ACCOUNT")
    return _values(spark, sf_dir).select("id", S.identifier_key(kind, F.col("value")).alias("key"))


@query(f"""WITH {NAMES_SQL}, t AS (SELECT id, list_sort(list_filter(list_transform(string_split_regex(regexp_replace(lower(trim(name)), '^({_HONORIFIC}|kumari|km)\\.?\\s+', ''), '\\s+'), lambda w: regexp_replace(w, '^[.,;:"''()\\[\\]]+|[.,;:"''()\\[\\]]+$', '', 'g')), lambda w: w <> '')) AS w FROM names)
SELECT id, 'P:C' || (id % 3) || ':' || array_to_string(w, ' ') AS key FROM t""")  # fmt: skip
def fn_person_key(spark, sf_dir):
    case = F.concat(F.lit("C"), (F.col("id") % 3).cast("string"))
    return _names(spark, sf_dir).select("id", S.person_key(case, F.col("name")).alias("key"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def fn_wording(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.wording(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(f) > 240 THEN substr(f, 1, 239) || '…' ELSE f END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def fn_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query("SELECT event_id, substr(sha256(user_id || chr(31) || event_type || chr(31) || event_id), 1, 12) AS key FROM events")
def fn_short_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.short_hash(12, F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")).alias("key"))


@query("SELECT (ts + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS events FROM events GROUP BY 1")
def fn_ist_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(S.ist_day(F.col("ts")).alias("day")).agg(F.count("*").alias("events"))


_DATED = """dated AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'seen on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at noon' WHEN 1 THEN 'x ' || strftime(o_orderdate, '%-d/%-m/%Y') || ' then 2031-01-02'
  WHEN 2 THEN 'on the ' || strftime(o_orderdate, '%-d') || 'th ' || strftime(o_orderdate, '%B') || ', ' || strftime(o_orderdate, '%Y') ELSE 'no date 99/99/2020' END AS text, o_orderdate::DATE AS d FROM orders)"""


@query(f"WITH {_DATED} SELECT id, CASE WHEN id % 4 < 3 AND d >= DATE '2000-01-01' THEN d WHEN id % 4 = 1 THEN DATE '2031-01-02' END AS day FROM dated")
def fn_first_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("seen on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at noon"))).when(k % 4 == 1, F.concat(F.lit("x "), F.date_format(d, "d/M/yyyy"), F.lit(" then 2031-01-02")))
        .when(k % 4 == 2, F.concat(F.lit("on the "), F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM"), F.lit(", "), F.date_format(d, "yyyy"))).otherwise("no date 99/99/2020")
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), S.first_date(text).alias("day"))


@query("SELECT o_orderkey AS id, o_orderdate - INTERVAL 330 MINUTE AS moment FROM orders")
def fn_parse_moment(spark, sf_dir):
    """d/m/Y times without an offset are Indian time."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.parse_moment(text).alias("moment"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:,}', (floor(l_extendedprice) + CASE WHEN l_extendedprice - floor(l_extendedprice) > 0.5 OR (l_extendedprice - floor(l_extendedprice) = 0.5 AND floor(l_extendedprice) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT) AS money FROM lineitem")
def fn_alert_text(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.money_text(x).alias("money"))


def _name_pairs(spark, sf_dir):
    """Distinct part names that meet on a block: same first letter, close lengths."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("block", F.substring("name", 1, 1))
    a, b = names.toDF("a", "block"), names.toDF("b", "block")
    return a.join(b, "block").where("a < b")


@query()
def fn_indel_ratio(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("""WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT p.x AS a, q.x AS b FROM n p JOIN n q ON left(p.x, 1) = left(q.x, 1) AND p.x < q.x
WHERE length(p.x) + length(q.x) >= 20 AND abs(length(p.x) - length(q.x)) = 1 AND levenshtein(p.x, q.x) = 1""")
def names_match(spark, sf_dir):
    """Pairs of part names whose sorted words are at least 95 alike; a length test stands before the kernel."""
    a, b = S.token_sort(F.col("a")), S.token_sort(F.col("b"))
    pairs = _name_pairs(spark, sf_dir).where(S.maybe_similar(a, b))
    return pairs.where(S.indel_ratio(a, b) >= 95).select("a", "b")
