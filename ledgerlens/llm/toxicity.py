"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The classifier learns from a bounded, seeded sample of labelled rows.  Its
n-grams are hashed; executors count in how many sampled texts of each class a
bucket occurs, the driver keeps the FEATURES buckets whose counts differ most
significantly, scales each by its log-count ratio and fits a logistic model on
the sampled texts' kept buckets only.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, materialize, sample_labelled, utf8

FOLDS, HELD_OUT = 5, 0
#: Labelled rows of each class that are learnt from, at most.
SAMPLE_PER_CLASS = 1500
BITS = 18
SHORTEST, LONGEST = 3, 5
FEATURES = 2048
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: bytes | None) -> np.ndarray:
    """Hash buckets of all n-grams of SHORTEST to LONGEST characters of a lower-cased text, repeats included."""
    points = np.frombuffer((text or b"").decode().lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled, out = np.zeros(len(points), np.uint64), []
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * _SPREAD + points[n - 1 :]
        if n >= SHORTEST:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket, 0 where the bucket is not used
    bias: float

    def score(self, text: bytes | None) -> float:
        buckets = ngram_buckets(text)
        buckets = np.unique(buckets[self.weights[buckets] != 0])
        return float(1 / (1 + np.exp(-(self.weights[buckets].sum(dtype=np.float64) + self.bias))))


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts[class, bucket], texts[class]): in how many texts of a class a bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last place counts texts
        for batch in batches:
            for text, label in zip(utf8(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                counts[label][np.unique(ngram_buckets(text))] += 1
                counts[label][-1] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "n0", "n1"])

    rows = map_texts(sample, run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[0][rows["bucket"]], counts[1][rows["bucket"]] = rows["n0"], rows["n1"]
    return counts[:, :-1], counts[:, -1]


def _selected(sample: DataFrame, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of kept buckets' presence, labels) of the sampled texts, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in utf8(batch.column("text")):
                at = place[ngram_buckets(text)]
                found.append(np.unique(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "at"])

    rows = map_texts(sample, run, "doc_id long, label int, at array<int>").toPandas()
    rows = rows.assign(size=rows["at"].map(len)).sort_values(["doc_id", "label", "size"], kind="stable")
    matrix = np.zeros((len(rows), FEATURES), np.float32)
    for i, at in enumerate(rows["at"]):
        matrix[i, at] = 1
    return matrix, rows["label"].to_numpy(np.float32)


def _logistic(matrix: np.ndarray, labels: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with per-weight scales, on all rows each round."""
    x = np.hstack([matrix, np.ones((len(matrix), 1), np.float32)])
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for i in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - labels) / np.float32(len(labels))
        g = error @ x + np.float32(ridge) * w
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.99) * v + np.float32(0.01) * g * g
        w = (w - np.float32(0.02) * (m / np.float32(1 - 0.9**i)) / (np.sqrt(v / np.float32(1 - 0.99**i)) + np.float32(1e-7))).astype(np.float32)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most per_class labelled rows of each class; rows says which labels may be read."""
    rows = F.lit(True) if rows is None else rows
    sample = materialize(sample_labelled(documents, labels, label, rows, per_class), "toxicity-sample")
    counts, texts = _class_counts(sample)
    if not texts.all():  # without both classes every text gets the share of the known one
        share = (texts[1] + 0.5) / (texts.sum() + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    ratio = np.log((counts[1] + 1) / (texts[1] + 2)) - np.log((counts[0] + 1) / (texts[0] + 2))
    share = counts.sum(axis=0) / texts.sum()
    clear = np.abs(counts[1] / texts[1] - counts[0] / texts[0]) / np.sqrt(share * (1 - share) * (1 / texts).sum() + 1e-9)
    kept = np.argsort(-clear, kind="stable")[:FEATURES]
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(FEATURES, dtype=np.int32)
    matrix, wanted = _selected(sample, place)
    scale = ratio[kept].astype(np.float32)
    w, bias = _logistic(matrix * scale, wanted)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w * scale
    return Model(weights, bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score from 0 to 1, predicted (1 from 0.5 on).

    Null and empty texts have no n-grams and get the bias's score; texts shorter
    than SHORTEST characters likewise.  Repeated rows are scored each and alike.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t) for t in utf8(batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_texts(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learnt from the rows that are not held out."""
    model = train(documents, labels, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
