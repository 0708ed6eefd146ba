"""Incremental builds, status tables and feedback sessions over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_EVENTS, EXPIRY_HOURS = 5, 24


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert replayed."""
    columns = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return last.select(*keys, "__r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows in the place of old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_or_ignore(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first table's row of each key."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("__i", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__i")
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__i", "__r")


def decision(recompute: Column, status: Column, fingerprint: Column, wanted: Column, valid: Column, retry_failed: Column) -> Column:
    """What to do with a module: the first rule that holds."""
    return (
        F.when(recompute, "run:recompute")
        .when(status.isNull(), "run:new")
        .when(~fingerprint.eqNullSafe(wanted), "run:changed")
        .when((status == "completed") & valid, "skip:completed")
        .when(status == "completed", "run:corrupt")
        .when((status == "failed") & ~retry_failed, "skip:failed")
        .when(status == "failed", "run:retry")
        .when(status == "disabled", "skip:disabled")
        .otherwise("run:interrupted")
    )


def decide(registry: DataFrame, wanted: DataFrame, keys: list[str], recompute: bool = False, retry_failed: bool = False) -> DataFrame:
    """wanted (keys, wanted_fingerprint) with the decision by registry (keys, status, fingerprint, valid)."""
    out = wanted.join(registry.select(*keys, "status", "fingerprint", "valid"), keys, "left")
    return out.withColumn("decision", decision(F.lit(recompute), F.col("status"), F.col("fingerprint"), F.col("wanted_fingerprint"), F.coalesce("valid", F.lit(False)), F.lit(retry_failed)))


def pending(wanted: DataFrame, cached: DataFrame, keys: list[str], fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(rows to do, cached rows to reuse): reuse where key and fingerprint are the same."""
    return wanted.join(cached.select(*keys, fingerprint), [*keys, fingerprint], "left_anti"), cached.join(wanted.select(*keys, fingerprint), [*keys, fingerprint], "left_semi")


def skip_ready(status: DataFrame, fingerprint: str) -> DataFrame:
    """Rows whose state is ready (or has no audio) for this fingerprint."""
    return status.where((F.col("fingerprint") == fingerprint) & F.col("state").isin("ready", "no_audio"))


def stale(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, reason) where sources' checksums (path, sha256) are not the manifest's."""
    both = current.select("path", F.col("sha256").alias("now")).join(manifest.select("path", F.col("sha256").alias("then")), "path", "full")
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def status_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def run_state(modules: DataFrame) -> DataFrame:
    """A run's state by its modules' (run_id, status, checksum_ok): partial with a failure, running with one open, validated when all
    are done and their checksums hold, else completed."""
    out = modules.groupBy("run_id").agg(F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status") == "running").alias("r"), F.bool_and(F.coalesce("checksum_ok", F.lit(False))).alias("c"))
    return out.select("run_id", F.when(F.col("r"), "running").when(F.col("f"), "partial").when(F.col("c"), "validated").otherwise("completed").alias("state"))


# ---------------------------------------------------------------- sessions


def replay(events: DataFrame, most: int = MAX_EVENTS) -> DataFrame:
    """Sessions after their events (session_id, seq, kind, payload): start, refine, undo, reset, confirm.

    State is the list of active refinements and the revision, which starts at 0 and each refine, undo and reset raises; undo
    and reset of nothing do so too.  A refine beyond `most` active ones is refused, as is, where events have the column
    expected_revision, one that doesn't name the current revision.  The first confirmation stands.
    """
    checked = "expected_revision" in events.columns
    expected = F.col("expected_revision").cast("int") if checked else F.lit(None).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "payload", expected.alias("expected"))))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("active"), F.lit(0).alias("revision"), F.lit(0).alias("refused"), F.lit(None).cast("string").alias("confirmed"))

    def step(s: Column, e: Column) -> Column:
        n = F.size(s["active"])
        ok = ~((e["kind"] == "refine") & (n >= most)) & (e["expected"].isNull() | (e["expected"] == s["revision"]))
        active = F.when(~ok, s["active"]).when(e["kind"] == "refine", F.concat(s["active"], F.array(e["payload"]))).when(e["kind"] == "undo", F.slice(s["active"], F.lit(1), F.greatest(n - 1, F.lit(0)))).when(e["kind"].isin("reset", "start"), none).otherwise(s["active"])
        raised = ok & e["kind"].isin("refine", "undo", "reset")
        return F.struct(active.alias("active"), (s["revision"] + F.when(raised, 1).otherwise(0)).alias("revision"), (s["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"), F.when(ok & (e["kind"] == "confirm"), F.coalesce(s["confirmed"], e["payload"])).otherwise(s["confirmed"]).alias("confirmed"))

    return events.groupBy("session_id").agg(ordered.alias("e")).select("session_id", F.aggregate("e", start, step).alias("s")).select("session_id", "s.*")


def first_correct(events: DataFrame) -> DataFrame:
    """events (session_id, ts_ms, kind): ms from a session's start to its first correct result, and its cohort by whether feedback
    came before."""
    start = F.min(F.when(F.col("kind") == "start", F.col("ts_ms")))
    correct = F.min(F.when(F.col("kind") == "correct", F.col("ts_ms")))
    refine = F.min(F.when(F.col("kind") == "refine", F.col("ts_ms")))
    out = events.groupBy("session_id").agg(start.alias("s"), correct.alias("c"), refine.alias("r")).where("s is not null and c is not null")
    return out.select("session_id", F.when(F.col("r") < F.col("c"), "feedback").otherwise("no_feedback").alias("cohort"), (F.col("c") - F.col("s")).alias("elapsed_ms"))


def confirmations(events: DataFrame) -> DataFrame:
    """Each (session_id, revision, video_id, frame_id) once."""
    return events.dropDuplicates(["session_id", "revision", "video_id", "frame_id"])


def active_runs(artifacts: DataFrame, now_ms: int) -> DataFrame:
    return artifacts.where(F.col("expires_ms") > now_ms).select("run_id").distinct()
