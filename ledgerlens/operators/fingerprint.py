"""One text for equal values, and digests of whole tables that merge by partition and tell where two tables differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType

from ..sources.storage import stored

#: Hex digits of a key's hash that name its bucket: 16 children a node, 4096 buckets.
DEPTH = 3
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _quoted(text: Column) -> Column:
    """A JSON string of ASCII only, other characters as their UTF-16 units."""
    short = F.create_map(*(F.lit(x) for kv in _SHORT.items() for x in kv))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
    spelled = F.transform(F.split(text, ""), lambda c: F.when(c == "", "").otherwise(F.coalesce(F.get(F.filter(F.array(F.element_at(short, c)), lambda x: x.isNotNull()), F.lit(0)), F.when(c.rlike("^[ -~]$"), c), units(c))))
    body = F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(F.array_join(spelled, ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(column: Column, kind: DataType) -> Column:
    """Compact JSON with sorted keys: equal for equal values, whatever the order of struct fields or map entries.

    Null is written as null, also inside; whole numbers, booleans and text as JSON
    has them, other values as Spark's text in quotes.  Map keys are text.
    """
    if isinstance(kind, StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(column.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_quoted(e.getField("key").cast("string")), F.lit(":"), canonical_json(e.getField("value"), kind.valueType))
        # The quoted keys are unique and in ASCII, so the written entries sort as their keys do.
        body = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(column), entry)), ","), F.lit("}"))
    elif isinstance(kind, BooleanType | IntegralType):
        body = column.cast("string")
    else:
        body = _quoted(column if isinstance(kind, StringType) else column.cast("string"))
    return F.coalesce(body, F.lit("null"))


def _hashed(rows: DataFrame, key: list[str]) -> DataFrame:
    """(bucket, name, sum_a, sum_b) of each row: its bucket by key, and its canonical text's digest in two numbers."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    text = lambda names: F.concat_ws(",", *(F.concat(_quoted(F.lit(c)), F.lit(":"), canonical_json(F.col(f"`{c}`"), types[c])) for c in sorted(names)))
    told = rows.select(F.sha2(text(key), 256).alias("name"), F.sha2(text(rows.columns), 256).alias("digest"))
    piece = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)")
    return told.select(F.substring("name", 1, DEPTH).alias("bucket"), "name", piece(1).alias("a"), piece(16).alias("b"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """(node, n, digest) of a tree of hex digits over the keys' hashes; the node '' is the fingerprint of the table.

    Sums of row digests do not depend on order or partitions and count repeats; a
    node's digest is the SHA-256 of its sums.  They tell tables apart that differ by
    accident, not by design.
    """
    nodes = [_summed(_hashed(rows, key), ["bucket"])]
    for length in range(DEPTH - 1, -1, -1):
        nodes.append(nodes[-1].groupBy(F.substring("bucket", 1, length).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")))
    every = reduce(DataFrame.unionByName, nodes)
    return every.select(F.col("bucket").alias("node"), "n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("digest"))


def differences(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """(name, n_one, n_other): hashes of the keys whose rows differ, and how many rows each side has of them.

    Digests are compared from the root down; only buckets that differ are read by key.
    """
    sides = [stored(_hashed(x, key), "fingerprint-rows") for x in (one, other)]
    trees = [stored(digests(x, key), "fingerprint-tree") for x in (one, other)]
    front = one.sparkSession.createDataFrame([("",)], "node string")
    for length in range(DEPTH + 1):
        a, b = (t.join(front, "node", "left_semi").select("node", F.col("digest").alias(n)) for t, n in zip(trees, ("da", "db"), strict=True))
        unlike = a.join(b, "node", "full").where(~F.col("da").eqNullSafe(F.col("db"))).select("node")
        unlike = stored(unlike, "fingerprint-front")
        if length < DEPTH:
            digits = F.explode(F.array(*(F.lit(d) for d in "0123456789abcdef")))
            front = unlike.select("node", digits.alias("digit")).select(F.concat("node", "digit").alias("node"))
    a, b = (_summed(s.join(unlike.withColumnRenamed("node", "bucket"), "bucket", "left_semi"), ["name"]).toDF("name", f"n_{k}", f"a_{k}", f"b_{k}") for s, k in zip(sides, ("one", "other"), strict=True))
    same = F.col("n_one").eqNullSafe(F.col("n_other")) & F.col("a_one").eqNullSafe(F.col("a_other")) & F.col("b_one").eqNullSafe(F.col("b_other"))
    return a.join(b, "name", "full").where(~same).select("name", F.coalesce("n_one", F.lit(0).cast("long")).alias("n_one"), F.coalesce("n_other", F.lit(0).cast("long")).alias("n_other"))
