"""Frame policies: how the scored frames of a refinement window are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STABLE_PENALTY = 0.25
# The policies that a task may use.
TASK_POLICIES = {"KIS": ("representative",), "VQA": ("evidence",), "TRAKE": ("transition", "peak", "stable")}


def group_window():
    return Window.partitionBy("group_id").orderBy("timestamp_ms", "frame_id")


def transition_score(score: Column, time: Column, w=None) -> Column:
    """Change of score a ms since the row before; 0 for the first."""
    w = w or group_window()
    return F.coalesce(F.abs(score - F.lag(score).over(w)) / F.greatest(F.lit(1), time - F.lag(time).over(w)), F.lit(0.0))


def peak_score(score: Column, w=None) -> Column:
    """The score where it is not below a neighbour's, else the score less 1."""
    w = w or group_window()
    up = (score >= F.coalesce(F.lag(score).over(w), score)) & (score >= F.coalesce(F.lead(score).over(w), score))
    return F.when(up, score).otherwise(score - 1)


def stable_score(score: Column, penalty: float = STABLE_PENALTY, w=None) -> Column:
    """Mean of three rows less penalty times their population variance."""
    near = (w or group_window()).rowsBetween(-1, 1)
    return F.avg(score).over(near) - penalty * F.coalesce(F.var_pop(score).over(near), F.lit(0.0))


def standard_score(visual: Column, quality: Column, evidence: Column) -> Column:
    """visual + quality + the evidence's scores, each once."""
    return visual + quality + F.aggregate(F.coalesce(evidence, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)


def policy_score(policy: str, score: Column, time: Column) -> Column:
    if policy == "transition":
        return transition_score(score, time)
    if policy == "peak":
        return peak_score(score)
    if policy == "stable":
        return stable_score(score)
    if policy in ("representative", "evidence"):
        return score
    raise ValueError(f"no such policy: {policy}")


def check_policy(task: str, policy: str) -> None:
    if policy not in TASK_POLICIES.get(task, ()):
        raise ValueError(f"{policy} is no policy for {task}")


def rank_frames(frames: DataFrame, policy: str, task: str | None = None, limit: int | None = None) -> DataFrame:
    """frames (group_id, frame_id, pts, timestamp_ms, visual_score, score) ranked by policy value, visual score, distance of pts
    to that of the best frame, time, frame."""
    if task:
        check_policy(task, policy)
    out = frames.withColumn("policy_value", policy_score(policy, F.col("score"), F.col("timestamp_ms")))
    best = F.max_by("pts", F.struct(F.col("policy_value"), F.col("visual_score"), -F.col("timestamp_ms"), -F.col("frame_id"))).over(Window.partitionBy("group_id"))
    out = out.withColumn("target_pts", best)
    w = Window.partitionBy("group_id").orderBy(F.desc("policy_value"), F.desc("visual_score"), F.abs(F.col("pts") - F.col("target_pts")), "timestamp_ms", "frame_id")
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


def attach_evidence(frames: DataFrame, evidence: DataFrame) -> DataFrame:
    """frames with the scores of evidence (group_id, frame_id or null for all frames, score)."""
    own = evidence.where("frame_id is not null").groupBy("group_id", "frame_id").agg(F.collect_list("score").alias("__own"))
    common = evidence.where("frame_id is null").groupBy("group_id").agg(F.collect_list("score").alias("__all"))
    out = frames.join(own, ["group_id", "frame_id"], "left").join(common, "group_id", "left")
    none = F.array().cast("array<double>")
    return out.withColumn("evidence", F.concat(F.coalesce("__own", none), F.coalesce("__all", none))).drop("__own", "__all")


def manual_ranking(frames: DataFrame, coarse: DataFrame, limit: int = 5) -> DataFrame:
    """Without scores: the coarse frame (group_id, frame_id, timestamp_ms) first and once, then the frames nearest to it."""
    f = frames.select("group_id", "frame_id", "timestamp_ms").join(coarse.select("group_id", F.col("timestamp_ms").alias("__t"), F.col("frame_id").alias("__f")), "group_id")
    f = f.where("frame_id <> __f").select("group_id", "frame_id", "timestamp_ms", F.abs(F.col("timestamp_ms") - F.col("__t")).alias("d"), F.lit(1).alias("k")).unionByName(coarse.select("group_id", "frame_id", "timestamp_ms", F.lit(0).cast("long").alias("d"), F.lit(0).alias("k")))
    w = Window.partitionBy("group_id").orderBy("k", "d", "timestamp_ms", "frame_id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("d", "k")


def refinement_status(refined: Column, partial: Column) -> Column:
    return F.when(refined, "refined").when(partial, "partial").otherwise("manual_only")
