"""Detection and linking whose results do not depend on the order of arrival.

Each key (an account, a pair of callers, an identifier) keeps what it has seen in
the state store, so that a batch reads its own rows and the state of the keys they
name, never earlier batches.  What a late row changes is taken back: results are
changes of op 1 and -1, and their sums by row are what one batch over everything
would give.  Streams need the RocksDB state store; see stateful_session.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import alerts as A
from ..operators import graph as G
from .detect import append_new

ALERT_CHANGES = "kind string, severity string, key string, subject string, op int"
LINK_CHANGES = "record long, side string, owner string, op int"
_DAY = 86_400_000_000
_EPOCH = date(1970, 1, 1).toordinal()
#: Rows of changes that a key hands over at once, and records of a piece of its state.
_ROWS = 10_000


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that these streams need; spark's settings stay as they are."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def robust_scores(values: np.ndarray, min_days: int = A.MIN_BASELINE_DAYS) -> np.ndarray:
    """The z of operators.alerts.robust_z for the active days of one key, exact as there; none for fewer than min_days."""
    if len(values) < min_days:
        return np.full(len(values), -np.inf)
    deviation = values - np.median(values)
    mad = np.median(np.abs(deviation))
    if mad > 0:
        return deviation / (mad * A.MAD_TO_SIGMA)
    whole = [round(v * 100) for v in values.tolist()]
    n, total = len(whole), sum(whole)
    spread = n * sum(v * v for v in whole) - total * total
    return np.array([(n * v - total) / math.sqrt(spread) for v in whole]) if spread > 0 else np.zeros(n)


def _iso(day: int) -> str:
    return date.fromordinal(_EPOCH + int(day)).isoformat()


class _Raising(StatefulProcessor):
    """Keeps what a key has seen of each day and the alerts that stand for it, and hands over what changes.

    Days, their sums and instants are arrays of one state value, so that a batch
    reads and writes a key's state once, however many rows and days it brings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "days binary, sums binary, band binary")
        self.raised = handle.getMapState("raised", "key string", "kind string, severity string")

    def changes(self, subject: str, found: dict[str, tuple[str, str]]) -> Iterator[pd.DataFrame]:
        old = {k[0]: tuple(v) for k, v in self.raised.iterator()} if self.raised.exists() else {}
        rows = []
        for name in sorted(old.keys() | found.keys()):
            if old.get(name) == found.get(name):
                continue
            if name in old:
                rows.append((*old[name], name, subject, -1))
            if name in found:
                rows.append((*found[name], name, subject, 1))
                self.raised.updateValue((name,), found[name])
            else:
                self.raised.removeKey((name,))
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "severity", "key", "subject", "op"])

    def added(self, days: list[np.ndarray], values: list[np.ndarray], band: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(days in order, their sums, instants) of all that the key has seen, these rows with it."""
        if self.seen.exists():
            for arrays, held in zip((days, values, band), self.seen.get(), strict=True):
                arrays.append(np.frombuffer(held, np.int64))
        order, at = np.unique(np.concatenate(days), return_inverse=True)
        sums = np.zeros(len(order), np.int64)
        np.add.at(sums, at, np.concatenate(values))
        instants = np.concatenate([np.zeros(0, np.int64), *band])
        self.seen.update((order.tobytes(), sums.tobytes(), instants.tobytes()))
        return order, sums, instants

    def close(self) -> None:
        pass


class AccountAlerts(_Raising):
    """Structuring and spikes of an account: its sums of each day, and when it sent amounts just below the ceiling.

    Structuring comes first, and no spike is raised on the days of its evidence.
    """

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        days, cents, band = [], [], []
        for frame in rows:
            days.append(frame["day"].to_numpy(np.int64))
            cents.append(frame["cents"].to_numpy(np.int64))
            band.append(frame["us"].to_numpy(np.int64)[frame["band"].to_numpy(bool)])
        yield from self.changes(key[0], self.standing(key[0], *self.added(days, cents, band)))

    @staticmethod
    def standing(account: str, days: np.ndarray, cents: np.ndarray, band: np.ndarray) -> dict[str, tuple[str, str]]:
        found: dict[str, tuple[str, str]] = {}
        band = np.sort(band)
        span, quiet = A.STRUCTURING_DAYS * _DAY, set()
        if len(band):
            widths = np.searchsorted(band, band, "right") - np.searchsorted(band, band - span, "left")
            if widths.max() >= A.STRUCTURING_COUNT:
                end = band[widths.argmax()]  # the first of the widest runs
                run = band[(band >= end - span) & (band <= end)]
                quiet = set((run[: A.EVIDENCE_ROWS] // _DAY).tolist())
                found[f"STRUCTURING:{account}:{_iso(run[0] // _DAY)}"] = ("STRUCTURING", "high")
        scores = robust_scores(cents / 100)
        for i in np.flatnonzero(scores >= A.Z_THRESHOLD):
            if int(days[i]) not in quiet:
                found[f"TRANSACTION_SPIKE:{account}:{_iso(days[i])}"] = ("TRANSACTION_SPIKE", "high" if scores[i] >= A.Z_THRESHOLD + A.HIGH_MARGIN else "medium")
        return found


class PairAlerts(_Raising):
    """Bursts of a pair of callers: how often they called each other on each day."""

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        days = [frame["day"].to_numpy(np.int64) for frame in rows]
        order, counts, _ = self.added(days, [np.ones(len(d), np.int64) for d in days], [])
        found, scores = {}, robust_scores(counts.astype(float))
        for i in np.flatnonzero((counts >= A.MIN_BURST_CALLS) & (scores >= A.Z_THRESHOLD)):
            found[f"COMM_BURST:{key[0]}:{key[1]}:{_iso(order[i])}"] = ("COMM_BURST", "high" if scores[i] >= A.Z_THRESHOLD + A.HIGH_MARGIN else "medium")
        yield from self.changes(f"{key[0]}-{key[1]}", found)


class Links(StatefulProcessor):
    """The owner of an identifier, once one is known, on all records that name it, whichever came first.

    Records are kept by side in numbered pieces of _ROWS, of which only the last is
    written again, so that state is read and written by the piece, not by the record.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "owner string, seq long")
        self.pieces = handle.getMapState("pieces", "side string, number int", "records binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        before = tuple(self.owner.get()) if self.owner.exists() else None
        best, fresh = before, {}
        for frame in rows:
            sides, records = frame["side"].to_numpy(object), frame["record"].to_numpy(np.int64)
            for side in pd.unique(sides):
                here = pd.isna(sides) if pd.isna(side) else sides == side
                if side != "":
                    fresh.setdefault(None if pd.isna(side) else side, []).append(records[here])
                    continue
                for owner, seq in zip(frame["owner"].to_numpy(object)[here], frame["seq"].to_numpy(np.int64)[here].tolist(), strict=True):
                    if best is None or self.wins((owner, seq), best):
                        best = (owner, seq)
        fresh = {side: np.unique(np.concatenate(parts)) for side, parts in fresh.items()}
        last: dict[str | None, tuple[int, np.ndarray]] = {}
        for (side, number), (held,) in self.pieces.iterator() if self.pieces.exists() else ():
            records = np.frombuffer(held, np.int64)
            if side in fresh:
                fresh[side] = fresh[side][~np.isin(fresh[side], records)]
            if number >= last.get(side, (-1, None))[0]:
                last[side] = (number, records)
            if best != before:  # a new owner: every record of the identifier changes hands
                yield from self._told(records, side, before, best)
        for side, records in fresh.items():
            if best is not None:
                yield from self._told(records, side, None, best)
            if len(records):
                number, open_ = last.get(side, (0, records[:0]))
                records = np.concatenate([open_, records])
                for at in range(0, len(records), _ROWS):
                    self.pieces.updateValue((side, number + at // _ROWS), (records[at : at + _ROWS].tobytes(),))
        if best != before:
            self.owner.update(best)

    @staticmethod
    def wins(one: tuple[str, int], other: tuple[str, int]) -> bool:
        """Which of two owners an identifier has: that of the greatest (seq, owner)."""
        return (one[1], one[0]) > (other[1], other[0])

    @staticmethod
    def _told(records: np.ndarray, side: str | None, old: tuple[str, int] | None, new: tuple[str, int]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(records), _ROWS):
            part = records[at : at + _ROWS]
            for owner, op in ((old, -1), (new, 1)):
                if owner is not None:
                    yield pd.DataFrame({"record": part, "side": pd.Series([side] * len(part), dtype=object), "owner": owner[0], "op": op})

    def close(self) -> None:
        pass


def _day() -> Column:
    return F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")


def account_changes(txn: DataFrame) -> DataFrame:
    """Changes of structuring and spike alerts from arriving transfers (from_account, amount, ts); rows that lack one of these are left out.

    Amounts count to the hundredth.
    """
    whole = txn.where("from_account is not null and amount is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    band = (F.col("amount") >= A.STRUCTURING_CEILING * (1 - A.STRUCTURING_BAND)) & (F.col("amount") < A.STRUCTURING_CEILING)
    since = F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))  # within the session's day
    told = whole.select("from_account", (_day() * _DAY + since).alias("us"), _day().alias("day"), F.round(F.col("amount") * 100).cast("long").alias("cents"), band.alias("band"))
    return told.groupBy("from_account").transformWithStateInPandas(AccountAlerts(), ALERT_CHANGES, "Append", "None")


def pair_changes(calls: DataFrame) -> DataFrame:
    """Changes of burst alerts from arriving calls (caller, callee, ts); calls to oneself and rows that lack one of these are left out."""
    told = calls.where("caller <> callee and ts is not null").select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"), _day().alias("day"))
    return told.groupBy("a", "b").transformWithStateInPandas(PairAlerts(), ALERT_CHANGES, "Append", "None")


def link_changes(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Changes of who stands behind records (record, side, identifier) as owners (identifier, owner, seq) arrive, in any order.

    Of an identifier's owners that of the greatest seq counts, as in operators.evidence.with_owners; a record that comes twice counts once.
    """
    told = records.where("identifier is not null and record is not null").select(F.col("identifier").cast("string").alias("identifier"), F.col("record").cast("long").alias("record"), "side", F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("seq"))
    named = owners.where("identifier is not null and owner is not null and seq is not null").select(F.col("identifier").cast("string").alias("identifier"), F.lit(0).cast("long").alias("record"), F.lit("").alias("side"), "owner", F.col("seq").cast("long").alias("seq"))
    return told.unionByName(named).groupBy("identifier").transformWithStateInPandas(Links(), LINK_CHANGES, "Append", "None")


def keep_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of all rows that have arrived to the table at path, each once."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def standing(changes: DataFrame) -> DataFrame:
    """What stands after all changes."""
    own = [c for c in changes.columns if c != "op"]
    return changes.groupBy(*own).agg(F.sum("op").alias("op")).where("op > 0").drop("op")


def watch_top(edges: DataFrame, store: str, alerts_path: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame] = G.betweenness, column: str = "betweenness", top: int = 5) -> StreamingQuery:
    """Alerts for nodes that enter the top by a measure of the whole graph as edges (src, dst, weight) arrive.

    The first batch only remembers its top.  Every batch stores its edges and its
    top under its number, so one that runs again after a failure finds what it
    found before; alerts have the key CENTRALITY:id:rank and are raised once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/edges/batch={number}")
        known = spark.read.schema(rows.schema).parquet(*[f"{store}/edges/batch={i}" for i in range(number + 1)])
        whole = known.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        best = G.key_players(measure(whole).where(F.col(column) > 0), column, top)
        best.select("id", "rank").write.mode("overwrite").parquet(f"{store}/top/batch={number}")
        if number:
            now, before = (spark.read.schema("id long, rank int").parquet(f"{store}/top/batch={i}") for i in (number, number - 1))
            entered = now.join(before.select("id"), "id", "left_anti")
            append_new(entered.select(F.concat_ws(":", F.lit("CENTRALITY"), "id", "rank").alias("key"), F.lit("HIGH_CENTRALITY_SHIFT").alias("kind"), F.lit("medium").alias("severity"), "id", "rank"), alerts_path)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
