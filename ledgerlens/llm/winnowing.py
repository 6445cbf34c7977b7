"""Document fingerprints by winnowing.

Every run of K code points is hashed; of each WINDOW consecutive hashes the
smallest is chosen, the rightmost on ties, and kept with its position.  Any
passage of WINDOW + K - 1 code points that two texts share therefore gives both
the same chosen hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, row_keys

K = 12
WINDOW = 24
#: Documents of a run of neighbouring ids that is ordered at once, on average, up to MOST_RUNS runs; more documents make
#: longer runs, which are sorted on disk and passed through one row at a time.
RUN_DOCUMENTS = 4096
MOST_RUNS = 1 << 14
#: Runs that one id's rows (or those without an id) are dealt into by their row key, if they fill a run or have no id.
SUB_RUNS = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hash of every run of k code points, rolled by prefix sums modulo 2^64.

    A text of fewer than k code points is one gram; an empty one has none.
    """
    n = len(points)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    up, down = _powers(max(1 << 16, 1 << (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1]) >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen, in order of position."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    window = min(window, n)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))  # the rightmost is the smallest of equals
    span = 1
    while span * 2 <= window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < window:
        keys = np.minimum(keys[: len(keys) - (window - span)], keys[window - span :])
    chosen = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of chosen hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _written(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """documents' doc_id with the chosen hashes and their positions (null text: empty lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(code_points(t or ""), k, window) for t in batch.column("text").to_pylist()]
            lists = [pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "hashes", "positions"])

    return map_texts(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, hashes array<long>, positions array<long>")


def _bounds(documents: DataFrame) -> tuple[list[int], list[int]]:
    """(bounds, hot): ids that runs begin at, by approximate quantiles, MOST_RUNS at most; and the ids that fill a run alone."""
    row = documents.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least")).first()
    runs = max(1, min(MOST_RUNS, row.n // RUN_DOCUMENTS))
    if runs == 1:
        return [], []
    at = [i / runs for i in range(1, runs)]
    cuts = documents.agg(F.percentile_approx("doc_id", at, 10 * MOST_RUNS)).first()[0]
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    return sorted((set(cuts) | set(hot)) - {row.least}), hot


def _run_of(bounds: list[int], hot: list[int]) -> Column:
    """The run that a row (doc_id, row) is in; runs are numbered in the order of rows.

    Rows of a run's ids come in SUB_RUNS parts by row key where the id is hot or
    null, and the run's other rows, whose ids are larger, in one more after them.
    """
    sought, full = np.array(bounds, np.int64), np.array(hot, np.int64)

    def run(ids: pd.Series, none: pd.Series, rows: pd.Series) -> pd.Series:
        ids, none = ids.to_numpy(), none.to_numpy()
        base = np.where(none, 0, np.searchsorted(sought, ids, "right") + 1)
        part = (rows.to_numpy() >> 58) + SUB_RUNS // 2  # the leading bits, in order of the signed key
        return pd.Series(base * (SUB_RUNS + 1) + np.where(none | np.isin(ids, full), part, SUB_RUNS))

    return F.pandas_udf(run, "long")(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "row")


def edit_likeness(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next in descending (doc_id, row keys), and the first
    after the last; the edited text has its last floor(n_chars / 3) code points
    replaced by the next text's first as many (or all).  A fingerprint is the
    chosen hashes in order of position, 8 hex digits each ('' for an empty text).
    A null text is empty.  Rows with a null doc_id come after all others.
    Repeated rows follow each other.  A lone row is its own next.  Other columns
    are ignored.

    Runs of neighbouring ids, cut at quantiles, are ordered each on its own, and an
    id that fills runs alone is cut by row key.  A run's first row goes to the run
    before it too, so that its last row meets the next one.  No task holds more
    than a row and its successor.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *row_keys())
    run = _run_of(*_bounds(docs)).alias("run")
    keyed = docs.select("doc_id", "row", "row2", run)
    at = F.struct("doc_id", "row", "row2")
    heads = {r.run: r.head for r in keyed.groupBy("run").agg(F.max(at).alias("head")).collect()}  # a row for each run
    order = sorted(heads, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first run comes after the last
    ghosts = docs.sparkSession.createDataFrame([(heads[r].row, heads[r].row2, before[r]) for r in order], "row long, row2 long, run long")
    own = docs.select("doc_id", "text", "row", "row2", run, F.lit(0).alias("ghost"))
    extra = docs.join(F.broadcast(ghosts), ["row", "row2"]).select("doc_id", "text", "row", "row2", "run", F.lit(1).alias("ghost"))
    dealt = own.union(extra).repartition("run")
    dealt = dealt.sortWithinPartitions("run", "ghost", F.col("doc_id").desc_nulls_last(), F.desc("row"), F.desc("row2"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for its next; the run whose first ghost has come
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "ghost")), strict=True):
                doc_id, text, run, ghost = row
                if ghost and run == done:
                    continue
                points = code_points(text)
                now = (doc_id, text, points, winnow(points, k, window)[0])
                if held is not None:
                    out.append(_compare(held, now, k, window))
                held, done = (None, run) if ghost else (now, done)
            yield _batch(out)

    return map_texts(dealt.select("doc_id", "text", "run", "ghost"), walk, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(row: tuple, following: tuple, k: int, window: int) -> tuple:
    doc_id, text, points, chosen = row
    cut = len(points) // 3
    edited = text[: len(text) - cut] + following[1][:cut]
    changed = winnow(code_points(edited), k, window)[0]
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(points), digest, _written(chosen), _written(changed), likeness(chosen, changed), likeness(chosen, following[3])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)
