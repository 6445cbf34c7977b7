"""Detectors over transfers and calls: spikes, structuring, bursts, and alert bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
Z_THRESHOLD = 3.0
HIGH_MARGIN = 2.0
MIN_BASELINE_DAYS = 5
MIN_BURST_CALLS = 5
STRUCTURING_CEILING = 50_000.0
STRUCTURING_BAND = 0.10
STRUCTURING_DAYS = 7
STRUCTURING_COUNT = 3
EVIDENCE_ROWS = 12


def robust_z(daily: DataFrame, key: list[str], value: str, min_days: int = MIN_BASELINE_DAYS) -> DataFrame:
    """daily with the robust z of value among its key's active days; keys of fewer than min_days go.

    The deviation from the median over 1.4826 MAD; if the MAD is 0, the deviation
    from the mean over the population deviation; if that is 0 too, 0.  Days
    without activity are not filled in.  Values count to the hundredth there: mean
    and deviation come from exact sums, as a z on a threshold must not hang on the
    order in which doubles are added.
    """
    w = Window.partitionBy(*key)
    x = F.col(value)
    out = daily.withColumns({"days_active": F.count("*").over(w), "med": F.median(x).over(w)}).where(F.col("days_active") >= min_days)
    whole = F.round(x * 100).cast("decimal(18,0)")
    out = out.withColumns({"mad": F.median(F.abs(x - F.col("med"))).over(w), "sum": F.sum(whole).over(w), "squares": F.sum(whole * whole).over(w)})
    # n times the deviations from the mean, and n^2 times the variance.
    off, spread = F.col("days_active") * whole - F.col("sum"), F.col("days_active") * F.col("squares") - F.col("sum") * F.col("sum")
    z = F.when(F.col("mad") > 0, (x - F.col("med")) / (F.col("mad") * MAD_TO_SIGMA)).when(spread > 0, off.cast("double") / F.sqrt(spread.cast("double"))).otherwise(0.0)
    return out.withColumn("z", z).drop("sum", "squares")


def severity(z: Column, threshold: float = Z_THRESHOLD) -> Column:
    return F.when(z >= threshold + HIGH_MARGIN, "high").otherwise("medium")


def daily_totals(txn: DataFrame) -> DataFrame:
    return txn.groupBy("from_account", F.to_date("ts").alias("day")).agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("transfers"))


def transaction_spikes(txn: DataFrame, threshold: float = Z_THRESHOLD, suppressed: DataFrame | None = None) -> DataFrame:
    """Days on which an account sent far more than on its usual days; suppressed: (from_account, day) to leave out."""
    found = robust_z(daily_totals(txn), ["from_account"], "total").where(F.col("z") >= threshold)
    if suppressed is not None:
        found = found.join(suppressed, ["from_account", "day"], "left_anti")
    return found.select("from_account", "day", "total", "transfers", F.round("z", 2).alias("z"), severity(F.col("z"), threshold).alias("severity"))


def structuring_band(txn: DataFrame, ceiling: float = STRUCTURING_CEILING, band: float = STRUCTURING_BAND) -> DataFrame:
    """Transfers just below the reporting ceiling: floor <= amount < ceiling."""
    return txn.where((F.col("amount") >= ceiling * (1 - band)) & (F.col("amount") < ceiling))


def _widest(txn: DataFrame, ceiling: float, days: int, least: int) -> tuple[DataFrame, DataFrame]:
    band = structuring_band(txn, ceiling)
    stamp = F.col("ts").cast("timestamp")
    band = band.withColumn("us", F.unix_micros(stamp))
    span = days * 86_400_000_000
    trailing = Window.partitionBy("from_account").orderBy("us").rangeBetween(-span, 0)
    counted = band.withColumn("n", F.count("*").over(trailing))
    # The first of the widest runs; rows of one instant share their count.
    ends = counted.groupBy("from_account").agg(F.max("n").alias("n"), F.max_by("us", F.struct("n", -F.col("us"))).alias("end_us")).where(F.col("n") >= least)
    rows = band.join(ends, "from_account").where((F.col("us") >= F.col("end_us") - span) & (F.col("us") <= F.col("end_us")))
    return rows, ends


def structuring(txn: DataFrame, ceiling: float = STRUCTURING_CEILING, days: int = STRUCTURING_DAYS, least: int = STRUCTURING_COUNT) -> DataFrame:
    """An account's widest run of transfers just below the ceiling within a sliding window."""
    rows, _ = _widest(txn, ceiling, days, least)
    out = rows.groupBy("from_account").agg(F.count("*").alias("transfers"), F.round(F.sum("amount"), 2).alias("total"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    return out.select("from_account", "transfers", "total", "first_day", (F.datediff("last_day", "first_day") + 1).cast("long").alias("span_days"))


def structuring_days(txn: DataFrame, ceiling: float = STRUCTURING_CEILING, evidence_rows: int = EVIDENCE_ROWS) -> DataFrame:
    """(from_account, day) of the first evidence rows of each structuring run: days on which no spike is raised."""
    rows, _ = _widest(txn, ceiling, STRUCTURING_DAYS, STRUCTURING_COUNT)
    order = Window.partitionBy("from_account").orderBy("us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= evidence_rows).select("from_account", F.to_date("ts").alias("day")).distinct()


def comm_bursts(calls: DataFrame, threshold: float = Z_THRESHOLD, least: int = MIN_BURST_CALLS) -> DataFrame:
    """Days on which a pair called each other far more than usual, in either direction."""
    pair = [F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")]
    daily = calls.where("caller <> callee").groupBy(*pair, F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("duration_sec", F.lit(0))).alias("talk_sec"))
    found = robust_z(daily, ["a", "b"], "calls").where((F.col("calls") >= least) & (F.col("z") >= threshold))
    return found.select("a", "b", "day", "calls", "talk_sec", F.round("z", 2).alias("z"), severity(F.col("z"), threshold).alias("severity"))


def alerts(txn: DataFrame, calls: DataFrame) -> DataFrame:
    """All alerts in one envelope: kind, severity, key, subject."""
    days = structuring_days(txn)
    s = structuring(txn).select(
        F.lit("STRUCTURING").alias("kind"), F.lit("high").alias("severity"), F.concat_ws(":", F.lit("STRUCTURING"), "from_account", F.col("first_day").cast("string")).alias("key"), F.col("from_account").alias("subject")
    )
    t = transaction_spikes(txn, suppressed=days).select(
        F.lit("TRANSACTION_SPIKE").alias("kind"), "severity", F.concat_ws(":", F.lit("TRANSACTION_SPIKE"), "from_account", F.col("day").cast("string")).alias("key"), F.col("from_account").alias("subject")
    )
    b = comm_bursts(calls).select(
        F.lit("COMM_BURST").alias("kind"), "severity", F.concat_ws(":", F.lit("COMM_BURST"), "a", "b", F.col("day").cast("string")).alias("key"), F.concat_ws("-", "a", "b").alias("subject")
    )
    return s.unionByName(t).unionByName(b)


def new_alerts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose key is not stored yet: a second run raises nothing."""
    return found.join(stored.select("key"), "key", "left_anti").select("kind", "severity", "key", "subject")
