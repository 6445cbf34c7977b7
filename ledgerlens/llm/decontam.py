"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words and the alphabet is
the words themselves.  For each pattern length a table of two-word blocks says
how far the search may skip; where it says zero, the patterns that end in that
block are compared directly.

Benchmark items go to the tasks in closures whose size is checked: a larger
benchmark is dealt into blocks of bounded size.  One block at a time is fetched,
searched for and its hits stored before the next is fetched; the hits of all
blocks are merged once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize, row_keys, utf8

WINDOW = 10
#: Benchmark bytes searched at once.
BLOCK_BYTES = 16 << 20

# Bytes that separate words: ASCII other than digits and letters.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_BLANK).split() if text else []


class WuManber:
    """Patterns of one length: shift and hash tables over blocks of two words (one for single words)."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.ends.setdefault(pattern[-self.block :], []).append((list(pattern), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        length, far, shift, single = self.length, self.far, self.shift, self.block == 1
        at, last = length - 1, len(words)
        while at < last:
            key = (words[at],) if single else (words[at - 1], words[at])
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - length + 1
            here = words[start : at + 1]
            for pattern, items in self.ends[key]:
                if pattern == here:
                    yield start, items
            at += 1


def searchers(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(item)
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


def _hits(words: list[bytes], machines: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) word ranges and the items found."""
    found: set[str] = set()
    spans: list[tuple[int, int]] = []
    for machine in machines:
        for start, items in machine.search(words):
            spans.append((start, start + machine.length))
            found |= items
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, found


Items = list[tuple[str, bytes | None]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """(how many blocks, the blocks); a block is fetched when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    return count, ([(r.item_id, bytes(r.text)) for r in dealt.where(F.col("block") == b).collect()] for b in range(count))


_RAW = "row long, row2 long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _scan(base: DataFrame, items: Items, window: int) -> DataFrame:
    """The rows of base with their words counted, and the spans and items of the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = searchers(items, window)
        for batch in batches:
            counts, starts, ends, named = [], [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                merged, found = _hits(words, machines)
                counts.append(len(words))
                starts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
                named.append(sorted(found))
            longs = pa.list_(pa.int64())
            columns = [*(batch.column(c) for c in ("row", "row2", "doc_id")), pa.array(counts, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "row2", "doc_id", "n_words", "starts", "ends", "items"])

    return map_texts(base, run, _RAW)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items.

    A window is `window` consecutive words of an item (an item of fewer words is
    one window; one of none has none).  A document's word is hit if it lies in an
    occurrence of a window.  Null, empty and wordless texts have no words; an
    empty benchmark hits nothing; items with a null id or text are left out;
    repeated rows are judged each; other columns are ignored.
    """
    base = documents.select(F.col("doc_id").cast("long"), "text", *row_keys())
    count, blocks = _blocks(benchmark, block_bytes)
    found = _scan(base, next(blocks), window)
    if count > 1:
        found = materialize(found, "decontam-first")
        hits = [_spans(found)] + [_spans(materialize(_scan(base, items, window).where("size(items) > 0"), "decontam-block")) for items in blocks]
        found = _merged(found, hits)
    n_hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "starts", "ends", "items",
    )


def _spans(block: DataFrame) -> DataFrame:
    """(row, row2, spans, items) of the rows with hits.  Rows equal in id and text have equal hits, so one of them serves all."""
    spans = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")).alias("spans")
    return block.where("size(items) > 0").dropDuplicates(["row", "row2"]).select("row", "row2", spans, "items")


def _merged(base: DataFrame, hits: list[DataFrame]) -> DataFrame:
    """base with the hits of all blocks: a document's spans are sorted and the last one is widened while they touch."""
    union = F.expr(
        "aggregate(spans, cast(array() as array<struct<a: bigint, b: bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).b >= x.a, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))), "
        "concat(acc, array(named_struct('a', x.a, 'b', x.b)))))"
    )
    each = reduce(DataFrame.unionByName, hits).groupBy("row", "row2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    each = each.withColumn("spans", union).select("row", "row2", F.col("spans.a").alias("starts"), F.col("spans.b").alias("ends"), "items")
    empty = {c: F.coalesce(c, F.array()) for c in ("starts", "ends", "items")}
    return base.select("row", "row2", "doc_id", "n_words").join(each, ["row", "row2"], "left").withColumns(empty)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents without the contaminated ones; all columns as they are.

    The verdict is made row by row beside the row itself, so rows that share an id
    or have none are judged each, and nothing is joined.  A benchmark of several
    blocks filters once for each, and what is left is stored in between.
    """
    count, blocks = _blocks(benchmark, block_bytes)
    out = documents
    for number, items in enumerate(blocks):
        left = map_texts(out, _clean(items, window), documents.schema)
        if count > 1:
            left = materialize(left, "decontam-left")
            if number:
                discard(out)
        out = left
    return out


def _clean(items: Items, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = searchers(items, window)
        for batch in batches:
            texts = map(words_of, utf8(batch.column("text")))
            yield batch.filter(pa.array([not any(True for machine in machines for _ in machine.search(words)) for words in texts], pa.bool_()))

    return run
