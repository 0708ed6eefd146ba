"""The three kinds of query, from ranked branches to submission rows, for one query or a table of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import alignment, evidence, fusion, temporal

#: Answers looked for, candidates refined, rows of a submission.
ANSWERS, REFINED, MOST = 5, 5, 100


def checked_limit(limit: int, most: int = MOST) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is 1 to {most}")
    return limit


def stacked(branches: dict[str, DataFrame]) -> DataFrame:
    """Hits (query_id, video_id, frame_id, timestamp_ms, rank) of branches, with the branch and its place."""
    return reduce(DataFrame.unionByName, (b.select("query_id", "video_id", "frame_id", "timestamp_ms", "rank", F.col("rank").alias("pos"), F.lit(n).alias("branch"), F.lit(i).alias("branch_pos")) for i, (n, b) in enumerate(branches.items())))


def known_item(branches: dict[str, DataFrame], limit: int = MOST, cap: int = fusion.PER_VIDEO, width: int = fusion.DEDUP_MS) -> DataFrame:
    """(query_id, rank, video_id, frame_id, timestamp_ms, score) of every query: branches fused by video and time bucket, at most
    cap rows a video, ties in the order of the branches."""
    checked_limit(limit)
    hits = stacked(branches)
    # a query is part of the video's key while fusing
    keyed = hits.withColumn("video_id", F.struct("query_id", "video_id"))
    fused = fusion.by_bucket(keyed, width=width).select("video_id.query_id", "video_id.video_id", "frame_id", "timestamp_ms", "score", "seen", "branches")
    in_video = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "seen")
    ranked = fused.withColumn("__v", F.row_number().over(in_video)).where(F.col("__v") <= cap)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")))
    return ranked.where(F.col("rank") <= limit).drop("__v", "seen")


def refined(ranked: DataFrame, refine, most: int = REFINED) -> DataFrame:
    """ranked, with the frames that refine gives for its first rows (query_id, video_id, frame_id, new_frame_id) in their place."""
    better = refine(ranked.where(F.col("rank") <= most))
    out = ranked.join(better, ["query_id", "video_id", "frame_id"], "left")
    return out.withColumns({"refined": F.col("new_frame_id").isNotNull(), "frame_id": F.coalesce("new_frame_id", "frame_id")}).drop("new_frame_id")


def answers(ranked: DataFrame, frames: DataFrame, texts: DataFrame, most: int = ANSWERS, window: int = evidence.VQA_WINDOW) -> DataFrame:
    """The first candidates of each query with the answer found around them."""
    first = ranked.where(F.col("rank") <= most).withColumn("candidate_id", F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string")))
    packs = evidence.evidence_pack(first.select("candidate_id", "video_id", "timestamp_ms"), frames, texts, window)
    return first.join(evidence.answer(packs).select("candidate_id", "answer", "verified", "manual"), "candidate_id").drop("candidate_id")


def event_sequences(pools: DataFrame, compat: bool = False) -> DataFrame:
    """Hypotheses of each query over the video of its best candidate."""
    best = pools.select("query_id", "video_id", "score", "pos")
    chosen = alignment.one_video(pools, best)
    video = chosen.groupBy("query_id").agg(F.first("video_id").alias("video_id"))
    return alignment.hypotheses(alignment.align(chosen, compat)).join(video, "query_id")


def batch(queries: DataFrame, runners: dict[str, object]) -> dict[str, DataFrame]:
    """The results by task of a table of queries (query_id, task, ...): each runner gets its task's queries as one table.
    Queries of a task without a runner are skipped; task names go without regard to case."""
    named = queries.withColumn("task", F.upper(F.trim("task")))
    return {task: run(named.where(F.col("task") == task)) for task, run in runners.items()}


def skipped(queries: DataFrame, tasks: list[str]) -> DataFrame:
    """Queries whose task no runner takes."""
    return queries.where(~F.coalesce(F.upper(F.trim("task")).isin(tasks), F.lit(False))).select("query_id", "task")


def localised(hits: DataFrame, frames: DataFrame, media: DataFrame) -> DataFrame:
    """Hits of all sources as candidates on keyframes; those that can't be submitted are left out."""
    c = evidence.hits_to_candidates(hits, frames).where("submittable")
    return temporal.canonical(c.select(F.col("doc_id").alias("candidate_id"), "video_id", "timestamp_ms", "window_start_ms", "window_end_ms", F.array("source").alias("sources"), "score", "rank"), frames, media)
