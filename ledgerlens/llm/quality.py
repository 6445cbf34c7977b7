"""Quality scores by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.
Every whole text is cut into pieces that are compressed alone with either
dictionary, so that it is the dictionaries and not the text's own repeats that
shorten it.  The difference of the compressed sizes over the text's size,
calibrated by a logistic curve on labelled rows that built no dictionary, is the
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, sample_labelled, utf8

FOLDS, HELD_OUT = 3, 1
#: Labelled rows of each class that are learnt from, at most; half build dictionaries, half calibrate.
SAMPLE_PER_CLASS = 2000
DICTIONARY_BYTES = 256 << 10
#: Pieces of a sampled text that may go into a dictionary, taken at even distances from the whole text; scoring reads all.
TRAIN_PIECES, TRAIN_PIECE_BYTES = 8, 1000
PIECE = 300
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0

    def meter(self) -> _Meter:
        return _Meter(self)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.bias, -500, 500)))


class _Meter:
    """The compressors of a task."""

    def __init__(self, model: Model):
        self.good, self.bad = (
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)
        )

    def difference(self, text: bytes | None) -> float:
        """(bad size - good size) / size over all pieces; 0 for an empty text."""
        if not text:
            return 0.0
        good, bad, total = self.good.compress, self.bad.compress, 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            total += len(bad(piece)) - len(good(piece))
        return total / len(text)


def train_pieces(text: bytes) -> list[bytes]:
    """All of a text in pieces, or TRAIN_PIECES of them at even distances from first to last."""
    starts = range(0, len(text), TRAIN_PIECE_BYTES)
    if len(starts) > TRAIN_PIECES:
        starts = [starts[i * (len(starts) - 1) // (TRAIN_PIECES - 1)] for i in range(TRAIN_PIECES)]
    return [text[i : i + TRAIN_PIECE_BYTES] for i in starts]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to select from: the samples themselves are the dictionary
        return b"\0" * 8 + b"".join(pieces)[-DICTIONARY_BYTES:]


def _fit(difference: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic slope and bias by Newton steps with a small ridge."""
    scale = float(difference.std()) or 1.0
    x = np.column_stack([difference / scale, np.ones(len(difference))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - labels)) + 1e-3 * w * np.array([1, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(documents: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most per_class labelled rows of each class; rows says which labels may be read.

    Classes weigh in the calibration as they occur among all labels that may be
    read.  If the half that builds dictionaries or the half that calibrates lacks a
    class, every score is the share of good ones among those labels (0.5 without
    any labels).  The driver holds TRAIN_PIECES pieces of each sampled row at most.
    """
    rows = F.lit(True) if rows is None else rows
    share = labels.where(F.col(label).isin(0, 1) & rows).agg(F.avg(F.col(label).cast("double"))).first()[0]
    sample = sample_labelled(documents, labels, label, rows, per_class)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    builders = sorted(_builders(sample.where(half == 0)).collect(), key=lambda r: r.doc_id)
    classes = [[bytes(p) for r in builders if r.label == value for p in r.pieces] for value in (0, 1)]
    # Until the curve is fitted, and where it cannot be, every text gets the share of good ones among the labels.
    prior = 0.5 if share is None else min(max(share, 0.01), 0.99)
    model = Model(_dictionary(classes[1]), _dictionary(classes[0]), 0.0, float(np.log(prior / (1 - prior))))
    if not all(classes):
        return model
    rest = _differences(sample.where(half == 1).select("doc_id", "text", "label"), model, "label").toPandas()
    rest = rest.sort_values(["doc_id", "difference"], kind="stable")
    wanted = rest["label"].to_numpy(float)
    if len(set(wanted)) < 2:
        return model
    own = wanted.mean()
    weight = np.where(wanted == 1, share / own, (1 - share) / (1 - own))
    model.slope, model.bias = _fit(rest["difference"].to_numpy(float), wanted, weight)
    return model


def _builders(sample: DataFrame) -> DataFrame:
    """(doc_id, label, pieces) of the sampled rows: what may go into a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = pa.array([train_pieces(t or b"") for t in utf8(batch.column("text"))], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pieces], names=["doc_id", "label", "pieces"])

    return map_texts(sample, run, "doc_id long, label int, pieces array<binary>")


def _differences(texts: DataFrame, model: Model, *also: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = model.meter()
        for batch in batches:
            values = np.array([meter.difference(t) for t in utf8(batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values), *(batch.column(c).cast(pa.int32()) for c in also)], names=["doc_id", "difference", *also])

    return map_texts(texts, run, ", ".join(["doc_id long, difference double", *(f"{c} int" for c in also)]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score from 0 to 1, predicted (1 from 0.5 on).

    Null and empty texts differ by 0 and get the curve's value there.  Repeated
    rows are scored each and alike.  Other columns are ignored.
    """
    found = _differences(documents.select(F.col("doc_id").cast("long"), "text"), model)
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("difference") * F.lit(model.slope) + F.lit(model.bias))))
    return found.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learnt from the rows that are not held out."""
    model = train(documents, labels, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those that the classifier rejects; rows and columns as they are otherwise.

    The verdict is made row by row beside the row itself, so nothing is joined.
    """
    model = train(documents, labels, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = model.meter()
        for batch in batches:
            values = np.array([meter.difference(t) for t in utf8(batch.column("text"))], np.float64)
            yield batch.filter(pa.array(model.probability(values) >= 0.5))

    return map_texts(documents, run, documents.schema)
