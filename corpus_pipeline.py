"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, linededup, neardocs, packing, quality, simhash
from ledgerlens.llm.common import materialize, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows, and documents left without text go."""
    return linededup.cut_documents(docs)


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five-word Jaccard of 0.8 or more, then SimHash) the one with the smallest doc_id stays."""
    return simhash.keep_one(neardocs.keep_one(docs))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", single_lines),
    ("simhash_near_dedup", single_documents),
    ("benchmark_decontamination", clean_documents),
    ("packing", packed_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over sf_dir's documents; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising, compression and MinHash have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
