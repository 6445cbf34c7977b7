"""Joins of many rows with one row per key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is split; at most its inverse of keys can be such.
SHARE = 1 / 500
#: Parts that a split key's rows are dealt into.
PARTS = 64


def join_split(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], total: int | None = None) -> DataFrame:
    """rows inner-joined with facts on keys; facts has one row per key and in n how many of the rows have it.

    Rows of hot keys get one of PARTS salts by a hash of the spread columns, and
    the hot keys' facts are repeated for each salt, so such a key is PARTS groups in
    the shuffle.  Only the hot keys are broadcast: 1 / SHARE of them at most,
    whatever the input.  Null keys match nothing.
    """
    if total is None:
        total = facts.agg(F.sum("n")).first()[0] or 0
    facts = facts.withColumn("_hot", F.col("n") > total * SHARE)
    hot = F.broadcast(facts.where("_hot").select(*keys, F.lit(True).alias("_split")))
    salt = F.when(F.col("_split"), F.pmod(F.xxhash64(F.lit("salt"), *spread), F.lit(PARTS))).otherwise(0).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_split")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(facts.withColumn("_salt", F.explode(salts)).drop("_hot"), [*keys, "_salt"]).drop("_salt")


def join_pairs(a: DataFrame, b: DataFrame, keys: list[str], by: str, parts: int = 16) -> DataFrame:
    """a inner-joined with b on keys, where a key has many rows on both sides: a's rows are dealt into parts by a hash of by, b's are repeated for each.

    Spark does not count the repeats, and would broadcast them: the join is a merge.
    """
    dealt = a.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), by), F.lit(parts)))
    repeated = b.withColumn("_part", F.explode(F.array(*(F.lit(i).cast("long") for i in range(parts)))))
    return dealt.join(repeated.hint("merge"), [*keys, "_part"]).drop("_part")
