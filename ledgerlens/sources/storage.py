"""Stored intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this process, in local runs only, removed at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return _OWN["root"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table and read it back: lineage ends there, and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
