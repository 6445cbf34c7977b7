"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.connected import components
from ..operators.skew import join_split
from ..sources.adapters import table
from ..sources.storage import discard
from ..sources.storage import stored as materialize

__all__ = ["components", "discard", "fold_of", "fold_of_value", "free_names", "join_split", "keep_first", "lower_ascii", "map_texts", "materialize", "row_keys", "sample_labelled", "table", "utf8"]

#: Rows that cross to a Python function at once; Spark bounds a batch's bytes itself.
TEXT_BATCH = 256


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of TEXT_BATCH rows, so that few whole texts are Python objects at a time."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(at, TEXT_BATCH) for batch in batches for at in range(0, batch.num_rows, TEXT_BATCH))

    return df.mapInArrow(sliced, schema)


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fold_of_value(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(row, row2): 128 bits that are equal for rows equal in id and text; null ids and texts have keys too."""
    return F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.xxhash64(F.col(text), F.col(doc_id)).alias("row2")


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """The names, each after as many underscores as it takes for rows to have no such column, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_first(documents: DataFrame, told: DataFrame) -> DataFrame:
    """documents without the rows that told says go: (row, row2, stays) for each row that is one of a group.

    Of rows equal in id and text that stay, one is kept.  What is joined with the
    documents names only rows that go or repeat; only rows that repeat are shuffled
    to drop their repeats.
    """
    counted = told.groupBy("row", "row2").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("not stays or n > 1")
    marks = materialize(counted.select("row", "row2", "stays"), "rows-marked")
    keys, columns = free_names(documents, "row", "row2"), [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.withColumns(dict(zip(keys, row_keys(), strict=True)))
    once = keyed.join(marks.toDF(*keys, "stays"), keys, "left_anti").select(*columns)
    many = marks.where("stays").select("row", "row2").toDF(*keys)
    if many.isEmpty():
        return once
    return once.unionByName(keyed.join(many, keys, "left_semi").dropDuplicates(keys).select(*columns))


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def sample_labelled(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most per_class training rows of each class.

    The rows are those whose hashed ids are smallest, so the choice depends on
    neither the partitions nor the order of the rows.  Only ids of the chosen
    rows are broadcast: at most 2 * per_class of them.  Of documents that share an
    id one is taken, the one whose text's hash is smallest.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    chosen = picked.select(F.col("doc_id").alias("_id"), "label")
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), texts.doc_id == chosen._id).select("doc_id", "text", "label")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
