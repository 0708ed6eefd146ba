"""Whole pipelines over the driver's tables: users are videos, event types are branches, weekdays are queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import adapters, evidence
from ..sources import writers
from . import retrieval
from .tables import EVENTS, events, frames, media, query, read, segments

_HITS = f"{EVENTS}, h as (select event_id % 7 as query_id, event_type as branch, video_id, frame_id, timestamp_ms, row_number() over (partition by event_id % 7, event_type order by value desc, event_id) as rank from ev), t as (select *, case branch when 'view' then 0 when 'click' then 1 else 2 end as bp from h where branch in ('view', 'click', 'purchase') and rank <= 100)"
_KIS = f"{_HITS}, f as (select query_id, video_id, timestamp_ms // 3600000 as bucket, sum(1.0 / (60 + rank)) as score, min_by(frame_id, struct_pack(a := rank, b := bp)) as frame_id, min(struct_pack(a := bp, b := rank)) as seen from t group by all), v as (select *, row_number() over (partition by query_id, video_id order by score desc, seen) as v from f), k as (select *, row_number() over (partition by query_id order by score desc, seen) as rank from v where v <= 5)"


def _branches(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("query_id", F.col("event_id") % 7)
    w = Window.partitionBy("query_id", "event_type").orderBy(F.desc("value"), "event_id")
    h = e.withColumn("rank", F.row_number().over(w)).where("rank <= 100")
    return {b: h.where(F.col("event_type") == b) for b in ("view", "click", "purchase")}


@query(f"with {_KIS} select query_id, rank, video_id, frame_id from k where rank <= 20")
def kis_pipeline(spark, sf_dir):
    """Seven queries' branches to submission rows."""
    return writers.kis_rows(retrieval.known_item(_branches(spark, sf_dir), 20, width=3600000))


@query()
def vqa_pipeline(spark, sf_dir):
    """Answers of the first candidates of each query."""
    ranked = retrieval.known_item(_branches(spark, sf_dir), 20, width=3600000)
    texts = segments(spark, sf_dir).select("video_id", F.lit("asr").alias("kind"), F.col("segment_id").alias("text"), "start_ms", "end_ms")
    return writers.qa_rows(retrieval.answers(ranked, frames(spark, sf_dir), texts, window=3600000))


@query()
def trake_pipeline(spark, sf_dir):
    """View, click and purchase in order, for each of seven queries, in its best video."""
    e = events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')")
    k = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    pools = e.select((F.col("event_id") % 7).alias("query_id"), k.cast("long").alias("event_index"), F.col("event_id").alias("pos"), "video_id", "frame_id", "timestamp_ms", F.col("value").alias("score"))
    return writers.trake_rows(retrieval.event_sequences(pools))


@query()
def localised_candidates(spark, sf_dir):
    """Speech and exact hits on keyframes."""
    s = segments(spark, sf_dir).select(F.col("segment_id").alias("doc_id"), F.lit("asr").alias("source"), "video_id", F.lit(None).cast("long").alias("frame_id"), F.lit(None).cast("long").alias("timestamp_ms"), "start_ms", "end_ms", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    o = frames(spark, sf_dir).select(F.concat(F.lit("f"), F.col("frame_id").cast("string")).alias("doc_id"), F.lit("ocr").alias("source"), "video_id", "frame_id", "timestamp_ms", F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return retrieval.localised(s.unionByName(o), frames(spark, sf_dir), media(spark, sf_dir)).select("candidate_id", "video_id", "frame_id")


@query(f"with {EVENTS}, f as (select video_id, frame_id, timestamp_ms from ev where event_type = 'view'), o as (select video_id, min_by(frame_id, struct_pack(a := timestamp_ms, b := frame_id)) as a from ev where event_type = 'error' and value > 60 group by video_id), m as (select video_id, max(timestamp_ms) // 2 as t from ev group by video_id), c as (select m.video_id, min_by(frame_id, struct_pack(d := abs(timestamp_ms - t), ms := timestamp_ms, f := frame_id)) as c from m left join f using (video_id) group by m.video_id) select video_id, cast(coalesce(a, c) as bigint) as frame_id, case when a is not null then 'ocr' else 'middle' end as anchor from c left join o using (video_id)")
def metadata_anchors(spark, sf_dir):
    """A video's first text frame (a high error), else the frame nearest to its middle."""
    ocr = events(spark, sf_dir).where("event_type = 'error' and value > 60").select("video_id", "frame_id", "timestamp_ms")
    none = frames(spark, sf_dir).where("false").select("video_id", "frame_id", F.lit(0).alias("rank"))
    return evidence.metadata_anchor(media(spark, sf_dir), ocr, none, frames(spark, sf_dir))


@query("select doc_id, upper(lang) as label, 'ready' as status from documents where doc_id % 10 <> 3 union all select doc_id, null, 'failed' from documents where doc_id % 10 = 3")
def adapter_run(spark, sf_dir):
    """A stand-in for a model over documents; every tenth document fails, alone."""

    def model(items):
        if any(x["doc_id"] % 10 == 3 for x in items):
            raise ValueError("not this one")
        return [[{"label": x["lang"].upper()}] for x in items]

    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return adapters.run(d, model, "label string", ["doc_id"]).select("doc_id", "label", "status")
