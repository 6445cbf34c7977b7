"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunkdedup, decontam, linededup, packing, quality, resampling, sharding, sigtree, simhash, toxicity, urlfilter, winnowing
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text."""
    return linededup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_likeness(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeats(table(spark, sf_dir, "documents")).drop("row")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality, op3_simhash, op4_packing, op5_line_dedup, op6_url_filter, op7_sharding, op8_decontamination, op9_winnowing, op10_substring_dedup, op11_resampling, op12_jaccard_join, op13_alignment)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 by its definition: the table is the polynomial 0xEDB88320 applied eight times to each byte.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP7_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, {_STEP} FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, coalesce(source, '') AS source, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) + 16 AS size
  FROM documents
), checked AS (
  SELECT doc_id, source, size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc
), sized AS (
  SELECT *, ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null:' || text_crc32)), 1, 15))::BIGINT AS key FROM checked
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) - 1 AS rnk, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rnk + 1)::DOUBLE / (2 * n)::DOUBLE, source, key, doc_id, size, text_crc32) - 1 AS place FROM ranked
), dealt AS (SELECT *, ((place + 1) * 40 - 1) // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - shard * total // 40)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM dealt
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, s.n, item FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

# Each distinct feature's CRC-32 once, by the table of the rule above.
OP11_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, {_STEP} FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
texts AS (
  SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w, true AS source FROM documents
  UNION ALL SELECT NULL, -row_number() OVER (), {_WORDS}, false FROM benchmark
), features AS (
  SELECT r, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
), named AS (SELECT f, hex(encode(f)) AS hx FROM (SELECT DISTINCT f FROM features)),
hashed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM named, crc
), bucketed AS (SELECT r, source, bucket FROM features JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (WHERE source) AS s, count(*) FILTER (WHERE NOT source) AS t FROM bucketed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM bucketed JOIN gains USING (bucket) WHERE source GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(total::DOUBLE / n)::BIGINT END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h, r
  FROM texts LEFT JOIN weights USING (r) WHERE source
), noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features, weight) END AS k, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN k <= 25 * n // 100 THEN k::BIGINT END AS rank FROM ranked
"""

OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * met >= 85 * (x.n + y.n - met)),
reached AS (
  SELECT r AS a, r AS b FROM docs
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (r) JOIN reached ON d.r = a JOIN docs e ON e.r = b GROUP BY d.r, d.doc_id
"""

ORACLES: dict[str, str] = {"op11_resampling": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op7_sharding": OP7_SQL, "op8_decontamination": OP8_SQL}
