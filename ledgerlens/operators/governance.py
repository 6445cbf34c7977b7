"""Access, audit and stored evidence as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, stored


def live_grants(grants: DataFrame, now: Column, purpose: Column | None = None) -> DataFrame:
    """Grants neither revoked nor expired, for the purpose if one is given."""
    live = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return grants.where(live if purpose is None else live & (F.col("purpose") == purpose))


def authorized_cases(grants: DataFrame, now: Column) -> DataFrame:
    """(principal, purpose, case_id) that a live grant opens."""
    return live_grants(grants, now).select("principal", "purpose", "case_id").distinct()


def visible_workspaces(workspaces: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """(workspace, principal) whose cases are all opened to the principal for the workspace's purpose.

    workspaces: workspace, purpose, case_id, one row each case.
    """
    opened = authorized_cases(grants, now)
    asked = workspaces.groupBy("workspace", "purpose").agg(F.countDistinct("case_id").alias("asked"))
    given = workspaces.select("workspace", "purpose", "case_id").distinct().join(opened, ["purpose", "case_id"]).groupBy("workspace", "purpose", "principal").agg(F.count("*").alias("given"))
    return given.join(asked, ["workspace", "purpose"]).where("given = asked").select("workspace", "principal")


def permission_version(grants: DataFrame, now: Column) -> DataFrame:
    """A digest of each principal's live grants: it changes whenever what they may see does."""
    rows = authorized_cases(grants, now).select("principal", F.concat_ws(":", "purpose", F.col("case_id").cast("string")).alias("g"))
    return rows.groupBy("principal").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("g")), "|"), 256), 1, 16).alias("version"))


def audit_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def audit_verify(log: DataFrame) -> DataFrame:
    """(log_id, seq, problem) of entries whose digest or whose link to the entry before is wrong.

    log: log_id, seq, payload, prev_hash, hash.
    """
    before = F.lag("hash").over(Window.partitionBy("log_id").orderBy("seq"))
    own = audit_digest(F.col("prev_hash"), F.col("seq").cast("string"), F.col("payload"))
    problem = F.when(F.col("hash") != own, "altered").when(F.coalesce(F.col("before"), F.lit("")) != F.col("prev_hash"), "broken link")
    return log.withColumn("before", before).withColumn("problem", problem).where("problem is not null").select("log_id", "seq", "problem")


def store_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status) of a manifest (name, sha256) against stored files (name, content): intact, altered, missing or unlisted."""
    have = files.select("name", F.sha2("content", 256).alias("found"))
    j = manifest.join(have, "name", "full_outer")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "intact").otherwise("altered")
    return j.select("name", status.alias("status"))


def dedupe_content(documents: DataFrame) -> DataFrame:
    """The first row (smallest id) of each content within a case; rows: case_id, id, content."""
    return documents.groupBy("case_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def decision_history(*tables: tuple[str, DataFrame]) -> DataFrame:
    """All decisions of several tables (id, version, subject, state), each with its kind."""
    out = None
    for kind, t in tables:
        part = t.select(F.lit(kind).alias("kind"), "id", "version", "subject", "state")
        out = part if out is None else out.unionByName(part)
    return out


def apply_decisions(workspaces: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of the decisions asked (workspace, expected, id, subject, state) for workspaces (workspace, version).

    As if they came one after another in the order of their ids: a decision is
    accepted if it expects the version that the accepted ones before it have made,
    and makes the next one.  The others are refused as stale, or as unknown where
    there is no such workspace.

    Each decision points to the first later one that expects what it would make; the
    accepted ones are those that the first fitting one leads to.  Pointers are
    doubled, so a workspace of n accepted decisions takes log n rounds.
    """
    known = stored(asked.join(workspaces.select("workspace", "version"), "workspace", "left"), "decisions-asked")
    able = known.where("expected >= version").select("workspace", "expected", "id")
    reached = stored(known.where("expected = version").groupBy("workspace").agg(F.min("id").alias("id")), "decisions-reached")
    seeks = able.select("workspace", (F.col("expected") + 1).alias("made"), "id", F.lit(None).cast("long").alias("found"), F.lit(0).alias("rank"))
    offers = able.select("workspace", F.col("expected").alias("made"), "id", F.col("id").cast("long").alias("found"), F.lit(1).alias("rank"))
    later = Window.partitionBy("workspace", "made").orderBy(F.desc("id"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = offers.unionByName(seeks).withColumn("following", F.last("found", ignorenulls=True).over(later))
    jump = stored(seen.where("rank = 0 and following is not null").select("workspace", "id", "following"), "decisions-jump")
    while not jump.isEmpty():
        led = reached.join(jump, ["workspace", "id"]).select("workspace", F.col("following").alias("id"))
        old, reached = reached, stored(reached.union(led).distinct(), "decisions-reached")
        on = jump.select("workspace", F.col("id").alias("following"), F.col("following").alias("beyond"))
        before, jump = jump, stored(jump.join(on, ["workspace", "following"]).select("workspace", "id", F.col("beyond").alias("following")), "decisions-jump")
        discard(old, before)
    told = known.join(reached.withColumn("taken", F.lit(True)), ["workspace", "id"], "left")
    accepted = told.where("taken").select("workspace", (F.col("expected") + 1).alias("version"), "id", "subject", "state")
    refused = told.where("taken is null").select("workspace", "id", F.when(F.col("version").isNull(), "unknown workspace").otherwise("stale version").alias("reason"))
    return accepted, refused


def bump_versions(workspaces: DataFrame, cases: DataFrame, touched: DataFrame) -> DataFrame:
    """(workspace, version): one more for every workspace that holds a touched case (case_id); cases: workspace, case_id."""
    hit = cases.join(touched.select("case_id").distinct(), "case_id", "left_semi").select("workspace").distinct().withColumn("hit", F.lit(1))
    return workspaces.join(hit, "workspace", "left").select("workspace", (F.col("version") + F.coalesce("hit", F.lit(0))).alias("version"))


def export_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The files (name, content) of a manifest (name, sha256); raises if one is altered, missing or unlisted."""
    wrong = store_verify(manifest, files).where("status <> 'intact'").orderBy("name").limit(5).collect()
    if wrong:
        raise ValueError("not exported: " + ", ".join(f"{r.name} is {r.status}" for r in wrong))
    return files.select("name", "content")


def scenario_status(runs: DataFrame, workspaces: DataFrame) -> DataFrame:
    """runs (run, workspace, version, failed) as failed, stale (the workspace moved on) or complete."""
    j = runs.join(workspaces.select("workspace", F.col("version").alias("current")), "workspace")
    return j.select("run", F.when(F.col("failed"), "failed").when(F.col("version") != F.col("current"), "stale").otherwise("complete").alias("status"))


def purge(rows: DataFrame, gone: DataFrame, key: str = "case_id") -> DataFrame:
    """rows without those of the purged keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
