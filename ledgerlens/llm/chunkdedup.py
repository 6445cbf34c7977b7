"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each step shifts the hash left by one and
adds the incoming byte's random value, so a bit depends on few bytes before it.
Where chosen bits are all zero a chunk ends.  Cuts depend on nearby bytes only,
so an insertion moves the chunks around it and no others.  Chunks with one digest
are one text; the first of them, by doc_id and place, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, map_texts, materialize, row_keys, utf8

#: Bits 12 to 16 of the gear hash: a cut every 32 bytes on average, past the least size.
CUT_MASK = 0b11111 << 12
LEAST_BYTES = 16
MOST_BYTES = 256
#: Repeated chunks side by side are reported from this many bytes on.
SPAN_BYTES = 112


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 32-bit values, by a rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], np.uint32)


def cut_points(data: bytes, gear: np.ndarray, mask: int = CUT_MASK, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> list[int]:
    """Ends of the chunks of data, the last one its length."""
    n = len(data)
    if not n:
        return []
    hashes = gear[np.frombuffer(data, np.uint8)].copy()
    span = 1
    while span < 32:  # the hash of a position sums the shifted values of its last 32 bytes
        hashes[span:] = hashes[span:] + (hashes[:-span] << np.uint32(span)) if span < n else hashes[span:]
        span *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((hashes & np.uint32(mask)) == 0) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


_CHUNKS = "row long, doc_id long, start int, length int, digest long, digest2 int"
_LONG, _INT = (1 << 64) - 1, (1 << 31) - 1


def chunks(documents: DataFrame) -> DataFrame:
    """Every chunk of every text: row (a key of id and text), doc_id, start and length in bytes, 95 bits of digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, digest = gear_table(), xxhash.xxh3_128_intdigest
        for batch in batches:
            owners, starts, lengths, digests = [], [], [], []
            for owner, data in enumerate(utf8(batch.column("text"))):
                ends = cut_points(data or b"", gear)
                begins = [0, *ends[:-1]] if ends else []
                owners += [owner] * len(ends)
                starts += begins
                lengths += [b - a for a, b in zip(begins, ends, strict=True)]
                digests += [digest(data[a:b]) for a, b in zip(begins, ends, strict=True)]
            long = np.array([d & _LONG for d in digests], np.uint64).view(np.int64)
            more = np.array([d >> 64 & _INT for d in digests], np.int32)
            places = pa.array(owners, pa.int32())
            columns = [batch.column(c).take(places) for c in ("row", "doc_id")]
            columns += [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(long), pa.array(more)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "start", "length", "digest", "digest2"])

    docs = documents.select(F.col("doc_id").cast("long"), "text", row_keys()[0])
    return map_texts(docs, run, _CHUNKS)


def repeats(documents: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """One row per maximal run of repeated chunks of span_bytes or more: doc_id, start, length, removable, n_chunks, first_doc_id, row.

    A chunk is repeated if its digest occurs more than once in all texts.  start
    and length count UTF-8 bytes.  removable is how many of the run's bytes have an
    earlier copy (by doc_id, then row key, then place); the run that is first
    itself has 0.  first_doc_id is the smallest id among the first copies.  Null
    and empty texts have no chunks; rows equal in id and text count as one; a null
    doc_id comes after all others.  Documents without repeats give no rows.  Other
    columns are ignored.  A chunk that very many rows hold is dealt into parts for
    both joins.
    """
    digest = ["digest", "digest2"]
    cut = materialize(chunks(documents), "chunkdedup-chunks")
    many = cut.groupBy(*digest).agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(join_split(cut, many, digest, ["row", "start"], cut.count()).drop("n"), "chunkdedup-repeated")
    # Rows equal in id and text give equal chunks at equal places: those are no copies of each other.
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    firsts = again.groupBy(*digest).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first <> last")
    found = join_split(again, firsts.drop("last"), digest, ["row", "start"], again.count()).select("row", "doc_id", "start", "length", (at != F.col("first")).alias("copy"), F.col("first.doc_id").alias("first_doc_id")).distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    fresh = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("length")).over(order), F.lit(True)).cast("int")
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy("doc_id", "row", "run").agg(
        F.min("start").cast("long").alias("start"), F.sum("length").cast("long").alias("length"),
        F.sum(F.when(F.col("copy"), F.col("length")).otherwise(0)).cast("long").alias("removable"), F.count("*").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"),
    )
    return spans.where(F.col("length") >= span_bytes).select("doc_id", "start", "length", "removable", "n_chunks", "first_doc_id", "row")
