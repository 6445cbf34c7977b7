"""SimHash near-duplicates by a grid join on per-segment bit counts.

A fingerprint's 64 bits are cut into segments and mapped to the number of one
bits in each: a point on an integer lattice.  The Manhattan distance of two
points is at most the Hamming distance of the fingerprints, so fingerprints at 2
or fewer differing bits lie at Manhattan distance 2 or less.  Two such lattice
points always share a lattice point at distance 1 or less from both; each
fingerprint is therefore sent to its own point and to the 2 * segments points
around it, and only fingerprints that meet at a point are candidates.  All
candidates are then verified on the full 64 bits.

The number of keys a fingerprint emits is fixed, so the work grows with the
rows.  A grid point where more than two fingerprints meet is not expanded into
pairs but refined to the grid of 64 segments of one bit, where a fingerprint's
point is the fingerprint itself and the points around it are its 64 one-bit
flips: all that meet at a point there are within 2 bits of each other for
certain, so linking each to the smallest loses no connection.  The more
fingerprints there are, the more of them go through the finer grid: 65 keys each
instead of 33, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, join_split, keep_first, map_texts, materialize, row_keys, utf8

MAX_BITS = 2
SEGMENTS = 16
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 15


def fingerprint_of(text: bytes | None, ngram: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text, 0 without words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    count = max(1, len(words) - ngram + 1)
    if len(words) <= ngram:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    for at in range(0, count, _BLOCK):
        part = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(documents: DataFrame, ngram: int = SHINGLE) -> DataFrame:
    """(doc_id, row, row2, fp long) for every row, row and row2 its keys; null and wordless texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint_of(t, ngram) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "row2")), pa.array(values.view(np.int64))], names=["doc_id", "row", "row2", "fp"])

    docs = documents.select(F.col("doc_id").cast("long"), "text", *row_keys())
    return map_texts(docs, run, "doc_id long, row long, row2 long, fp long")


def links(distinct: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(src, dst) fingerprints at MAX_BITS or fewer differing bits that keep all connections.

    distinct: one row for each fingerprint, column fp.
    """
    width = 64 // segments
    point, around = F.lit(0).cast("long"), []
    for i in range(segments):
        ones = F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)))
        own = F.xxhash64(F.lit(i), ones)
        point = point.bitwiseXOR(own)
        around += [own.bitwiseXOR(F.xxhash64(F.lit(i), ones + step)) for step in (1, -1)]
    # A point's key is the XOR of one hash for each segment; keys that clash only add candidates.
    keyed = distinct.select("fp", point.alias("point"), F.array(F.lit(0).cast("long"), *around).alias("moves"))
    points = keyed.select("fp", "point", F.explode("moves").alias("move")).select("fp", F.col("point").bitwiseXOR(F.col("move")).alias("key"))
    points = points.repartition("key")  # counted and joined back over the one exchange
    met = points.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    pairs = met.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    crowd = points.join(met.where("n > 2").select("key").hint("shuffle_hash"), "key", "left_semi").select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]
    near = materialize(crowd, "simhash-crowd").select("fp", F.explode(F.array(*flips)).alias("mid"))
    # The planner does not see that near has 65 rows for each fingerprint: it must not broadcast it.
    hubs = near.groupBy("mid").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("mid", "src")
    stars = near.join(hubs.hint("merge"), "mid").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS).where("src <> dst").distinct()


def _found(documents: DataFrame, ngram: int, segments: int) -> DataFrame:
    """(doc_id, row, row2, fp, first): first is the struct of the row that its component is named by."""
    prints = materialize(fingerprints(documents, ngram), "simhash-prints")
    classes = prints.groupBy("fp").agg(F.min(_at()).alias("own"), F.count("*").alias("n"))
    classes = materialize(classes, "simhash-classes")
    roots = components(links(classes.select("fp"), segments), "simhash")
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "own", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("own").alias("first"))
    of_print = materialize(named.join(least, "root").select("fp", "n", "first"), "simhash-components")
    return join_split(prints, of_print, ["fp"], ["row", "doc_id"])


def near_duplicates(documents: DataFrame, ngram: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in 2 or fewer bits.
    component_id is the smallest doc_id reachable.  Null, empty and wordless texts
    have fingerprint zero and link like any other; repeated rows keep their rows
    and share a component; a row without doc_id never names a component unless it
    is alone there (then component_id is null).  Other columns are ignored.
    """
    found = _found(documents, ngram, segments)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(documents: DataFrame, ngram: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """documents without the near copies: of each component one row stays, that of the smallest doc_id (null ids last, then by row keys).

    Rows equal in id and text are copies like any others.
    """
    found = _found(documents, ngram, segments)
    return keep_first(documents, found.select("row", "row2", (_at() == F.col("first")).alias("stays")))


def _at() -> Column:
    """The order of rows: by id, null ids last, then by row keys."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
