"""Shards that all hold the corpus's mixture of sources: proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's place in its
source, as a fraction of the source's rows, is its place in the interleaved
order; consecutive runs of that order are the shards.  Every prefix of the order
holds each source in proportion to within one row, and so does every shard.

Exact ranks over any number of rows come from counts: order keys are cut into
buckets by their leading bits, bucket counts give each bucket's first rank, and
only rows within a bucket are sorted.  A source with a third of all rows is so
spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
SEED = 11
ROW_BYTES = 16
#: Rows that a bucket holds on average.
BUCKET_ROWS = 256
MOST_BUCKET_BITS = 20
_KEY_BITS = 60


def _shuffle_key(seed: int) -> Column:
    """60 bits of the MD5 of seed and id, as a long; rows without an id are told apart by their texts' checksums."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string"))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("long")


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    law is `rows`: shard counts are at most one apart.  slot numbers a shard's rows
    from 0 in the interleaved order.  size is the text's UTF-8 bytes plus 16; a
    null text has no bytes.  A null source counts as the source ''.  Repeated rows
    are rows of their own; rows with equal keys are ordered by id, size and
    checksum, so only indistinguishable rows may change places.  Fewer rows than
    shards leave the last shards empty.  An empty table gives no rows.  Equal texts
    are not kept in one shard: a group of copies may hold more rows than the law
    allows a shard, and they are spread like their source's other rows.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    total = documents.select(F.lit(1)).count()
    bits = min(MOST_BUCKET_BITS, max(1, (max(1, total) // BUCKET_ROWS).bit_length()))
    bucket = F.shiftright("key", _KEY_BITS - bits)
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source, (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(sized.withColumn("key", _shuffle_key(seed)).withColumn("bucket", bucket), "sharding-rows")
    keys = rows.select("source", "bucket")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("source", "bucket").agg(F.count("*").alias("n")).select(
        "source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("source")).alias("of"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_crc32")
    ranked = rows.join(starts, ["source", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)

    # The place within the source as a fraction, and again exact ranks from bucket counts.
    fraction = (2 * F.col("rank") + 1).cast("double") / (2 * F.col("of")).cast("double")
    placed = ranked.withColumn("fraction", fraction).withColumn("run", F.floor(F.col("fraction") * (1 << bits)).cast("int"))
    placed = placed.select("doc_id", "source", "size", "text_crc32", "key", "fraction", "run")
    placed = materialize(placed, "sharding-ranks")
    below = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over 2^bits rows at most
    runs = placed.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("start"))
    order = Window.partitionBy("run").orderBy("fraction", "source", "key", "doc_id", "size", "text_crc32")
    ordered = placed.join(runs, "run").withColumn("place", F.col("start") + F.row_number().over(order) - 1)
    number = F.expr(f"((place + 1) * {shards} - 1) div {max(1, total)}")
    first = F.expr(f"(shard * {max(1, total)}L) div {shards}")
    return ordered.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
