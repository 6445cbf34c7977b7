"""Clues from per-frame detections: frames (run, frame, label, confidence), one row a detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a detected class means.
RELEVANCE = {
    "person": "person",
    "car": "vehicle", "truck": "vehicle", "bus": "vehicle", "motorcycle": "vehicle", "bicycle": "vehicle", "train": "vehicle", "boat": "vehicle",
    "backpack": "carried", "handbag": "carried", "suitcase": "carried",
    "cell phone": "device", "laptop": "device",
    "knife": "weapon", "scissors": "weapon", "baseball bat": "weapon",
}
MIN_CONFIDENCE = 0.35


def with_relevance(detections: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in RELEVANCE.items() for x in pair])
    return detections.withColumn("relevance", F.coalesce(F.try_element_at(table, F.col("label")), F.lit("ambient")))


def sample_index(total: int, wanted: int) -> list[int]:
    """Evenly spaced frame numbers: every max(1, total // wanted)-th, wanted at most."""
    return list(range(0, total, max(1, total // wanted)))[:wanted] if total > 0 and wanted > 0 else []


def clues(detections: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, kind, severity, frames): group or presence, carried item, vehicle, weapon, device; none for runs (run) without any."""
    d = with_relevance(detections)
    frames = d.groupBy("run", "frame").agg(
        F.count_if(F.col("label") == "person").alias("people"), F.max((F.col("relevance") == "carried").cast("int")).alias("carried"),
        F.max((F.col("relevance") == "vehicle").cast("int")).alias("vehicle"), F.max((F.col("relevance") == "weapon").cast("int")).alias("weapon"), F.max((F.col("relevance") == "device").cast("int")).alias("device"),
    )
    c = F.count_if
    per_run = frames.groupBy("run").agg(
        F.max("people").alias("peak"), c((F.col("people") > 0) & (F.col("carried") > 0)).alias("carried"), c(F.col("vehicle") > 0).alias("vehicle"),
        c(F.col("weapon") > 0).alias("weapon"), c(F.col("device") > 0).alias("device"),
    )
    at_peak = frames.join(per_run.select("run", "peak"), "run").groupBy("run").agg(c((F.col("people") == F.col("peak")) & (F.col("peak") > 0)).alias("peak_frames"))
    r = per_run.join(at_peak, "run")
    if runs is not None:
        r = runs.select("run").distinct().join(r, "run", "left").fillna(0)

    def rows(cond, kind, severity, n):
        return r.where(cond).select("run", F.lit(kind).alias("kind"), severity.alias("severity"), F.col(n).alias("frames") if isinstance(n, str) else n.alias("frames"))

    found = [
        rows("peak >= 2", "group", F.when(F.col("peak") >= 4, "high").otherwise("medium"), "peak_frames"),
        rows("peak = 1", "presence", F.lit("low"), "peak_frames"),
        rows("carried > 0", "carried_item", F.lit("medium"), "carried"),
        rows("vehicle >= 2", "vehicle", F.lit("medium"), "vehicle"),
        rows("weapon > 0", "weapon", F.lit("high"), "weapon"),
        rows("device > 0", "device", F.lit("low"), "device"),
        rows("peak < 1 and vehicle < 2 and weapon = 0 and device = 0", "none", F.lit("low"), F.lit(0).cast("long")),
    ]
    return reduce(DataFrame.unionByName, found)


def summary(detections: DataFrame) -> DataFrame:
    """Frames with detections, detections and distinct labels of each run, with its commonest label (smallest on ties)."""
    labels = detections.groupBy("run", "label").agg(F.count("*").alias("n"))
    top = labels.groupBy("run").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top_label"), F.count("*").alias("labels"))
    return detections.groupBy("run").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("detections")).join(top, "run")


def alert(found: DataFrame) -> DataFrame:
    """The worst severity among a run's clues, and how many there are."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return found.groupBy("run").agg(F.max_by("severity", rank).alias("severity"), F.count("*").alias("clues"))
