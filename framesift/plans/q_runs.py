"""Runs over a corpus: shot detection, keyframes, validators, shards, hashes and decoded frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import adapters, keyframes, mapping, validation
from ..sources import readers, writers
from . import retrieval
from .tables import EVENTS, SEGMENTS, SHOTS, events, frames, query, read, scratch, segments, shots

HOUR = 3_600_000


def _histograms(spark, sf_dir):
    """Each event as a frame whose histogram has three bins, of its value."""
    e = events(spark, sf_dir).where("value is not null")
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return e.select("video_id", "frame_id", "timestamp_ms", F.array(v, 1 - v, F.lit(0.1)).alias("histogram"))


_HIST = f"""{EVENTS}, h as (select video_id, frame_id, timestamp_ms, least(1, greatest(0, value / 100)) as v, row_number() over (partition by video_id, timestamp_ms // {HOUR} order by timestamp_ms, frame_id) as r from ev where value is not null),
p as (select *, lag(v) over (partition by video_id order by timestamp_ms, frame_id) as u from h where r = 1),
d as (select *, sqrt(greatest(0, 1 - (sqrt(u * v) + sqrt((1 - u) * (1 - v)) + sqrt(0.1 * 0.1)) / sqrt((u + (1 - u) + 0.1) * (v + (1 - v) + 0.1)))) as d from p where u is not null)"""


@query(f"with {_HIST} select video_id, frame_id, timestamp_ms, round(d, 6) as confidence from d where d > 0.48")
def histogram_boundaries(spark, sf_dir):
    """Frames whose histogram lies far from the sample before."""
    out = keyframes.histogram_boundaries(_histograms(spark, sf_dir), HOUR, 0.48)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""with {_HIST}, f as (select video_id, frame_id, timestamp_ms from ev where value is not null), e as (select video_id, min(frame_id) as a, max(frame_id) as z from f group by 1),
s as (select video_id, a as s, z from e union all select d.video_id, d.frame_id, z from d join e using (video_id) where d > 0.48 and d.frame_id > a),
n as (select video_id, s, coalesce(lead(s) over w - 1, z) as e, row_number() over w - 1 as k from s window w as (partition by video_id order by s))
select video_id, video_id || ':shot:' || lpad(cast(k as varchar), 6, '0') as shot_id, s as start_frame_id, e as end_frame_id from n""")
def detected_shots(spark, sf_dir):
    """Shots between the boundaries that histograms give; a video without any is one shot."""
    h = _histograms(spark, sf_dir)
    found = keyframes.shots(keyframes.histogram_boundaries(h, HOUR, 0.48), h)
    return found.select("video_id", "shot_id", "start_frame_id", "end_frame_id")


@query()
def extracted_keyframes(spark, sf_dir):
    """Keyframes of each shot: the best near its anchors, without copies, gaps filled."""
    cuts = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"))
    f = frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms", F.col("value").alias("quality"), F.xxhash64("frame_id").alias("hash"))
    return keyframes.extract(cuts, f, 48 * HOUR, 12 * HOUR, 3, 24 * HOUR)


@query("with s as (select vec_id // 100 as shard, vec_id from embeddings) select shard, min(vec_id) as record_start, max(vec_id) as record_end, count(*) as n from s group by shard")
def embedding_shards(spark, sf_dir):
    """The manifest of vectors written in shards of a hundred ids."""
    made = writers.embedding_shards(read(spark, sf_dir, "embeddings"), scratch(spark, "vectors"), 100)
    return made.select("shard", "record_start", "record_end", "n")


@query("select vec_id, embedding from embeddings where vec_id in (3, 150, 151)")
def shard_lookup(spark, sf_dir):
    """Vectors by id from the shards that hold them."""
    path = scratch(spark, "vectors")
    writers.embedding_shards(read(spark, sf_dir, "embeddings"), path, 100)
    return readers.embedding_shards(spark, path, [3, 150, 151]).select("vec_id", "embedding")


@query("with b as (select vec_id, i, case when embedding[i + 1] > embedding[i] then 1 else 0 end as b from embeddings, range(1, 56) t(i) where i % 8 <> 0) select vec_id, cast(sum(b * (1::hugeint << (48 - (i - 1 - i // 8)))) as bigint) as hash from b group by vec_id")
def difference_hash(spark, sf_dir):
    """Difference hashes of vectors seen as pictures of seven rows of eight."""
    return read(spark, sf_dir, "embeddings").select("vec_id", S.dhash(F.slice("embedding", F.lit(1), F.lit(56)), 8).alias("hash"))


@query("select l_returnflag as label, count(*) as n, count(*) filter (l_quantity < 10) as low from lineitem group by 1")
def label_summary(spark, sf_dir):
    """Rows by label, as a modality's summary counts them."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("canonical_label"), (F.col("l_quantity") < 10).alias("below_threshold"))
    reports = adapters.report(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.lit("ready").alias("status")), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id")))
    whole = adapters.summary(l, reports).select(F.explode("label_counts").alias("label", "n"))
    low = l.where("below_threshold").groupBy(F.col("canonical_label").alias("label")).agg(F.count("*").alias("low"))
    return whole.join(low, "label", "left").select("label", "n", F.coalesce("low", F.lit(0)).alias("low"))


@query("with d as (select l_orderkey as video_id, l_linenumber * 90 as pts, case when l_linenumber = 2 then 7 else l_linenumber end as t from lineitem), x as (select l_orderkey as video_id, l_linenumber * 90 as pts, l_linenumber as frame_id, l_linenumber as t from lineitem where l_linenumber <> 3) select d.video_id, d.pts, x.frame_id, case when x.frame_id is null then 'not in the index' when x.t <> d.t then 'times differ' end as fault from d left join x using (video_id, pts)")
def mapped_frames(spark, sf_dir):
    """Lines as decoded frames, found in an index that lacks each third and holds each second at another time."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * 90).alias("pts"), F.lit("1/90000").alias("time_base"), F.col("l_linenumber").alias("frame_id"))
    index = l.where("frame_id <> 3").withColumn("timestamp_ms", F.col("frame_id"))
    decoded = l.select("video_id", "pts", "time_base", F.when(F.col("frame_id") == 2, 7).otherwise(F.col("frame_id")).alias("timestamp_ms"))
    return mapping.resolved(decoded, index, strict=False).select("video_id", "pts", "frame_id", "fault")


@query("""with c as (select * from customer), o as (select o_custkey, o_orderkey, md5(cast(o_orderkey as varchar)) as h from orders)
select 'duplicate video' as rule, count(*) as n from (select o_custkey from o group by 1 having count(*) > 1) having count(*) > 0
union all select 'missing source', count(*) from o where o_custkey not in (select c_custkey from c where c_custkey % 7 <> 0) having count(*) > 0
union all select 'not a checksum', count(*) from o having count(*) > 0
union all select 'checksum differs', count(*) from o join c on c_custkey = o_custkey where c_custkey % 7 <> 0 and h <> md5(cast(c_custkey as varchar)) having count(*) > 0""")
def corpus_issues(spark, sf_dir):
    """Orders as media whose customers are their sources."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_custkey").alias("path"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("path"), F.md5(F.col("c_custkey").cast("string")).alias("sha256"))
    return validation.corpus(o, c).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""with {EVENTS}, f as (select video_id, frame_id, timestamp_ms as t, lag(timestamp_ms) over (partition by video_id order by frame_id) as b, row_number() over (partition by video_id order by frame_id) - 1 as p, min(timestamp_ms) over (partition by video_id) as o from ev)
select 'frame ids are not contiguous' as rule, count(*) as n from f where p <> frame_id having count(*) > 0
union all select 'time runs back', count(*) from f where t < b having count(*) > 0
union all select 'time and stamp differ', count(*) from f where abs((t - o + 3) - t) > 2 having count(*) > 0
union all select 'the first frame isn''t at zero', count(*) from (select video_id from f group by 1 having min(t) <> 0) having count(*) > 0""")
def frame_index_issues(spark, sf_dir):
    """Events as an index whose stamps run three milliseconds off."""
    from pyspark.sql.window import Window

    e = events(spark, sf_dir).withColumn("origin", F.min("timestamp_ms").over(Window.partitionBy("video_id")))
    index = e.select("video_id", "frame_id", "timestamp_ms", (F.col("timestamp_ms") + 3 - F.col("origin")).alias("pts"), F.lit(1).alias("time_base_num"), F.lit(1000).alias("time_base_den"), F.lit(0).cast("long").alias("origin_ms"))
    return validation.frame_index(index).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""with {SHOTS}, j as (select sh.shot_id, sh.video_id, f.frame_id from sh join fr f on f.video_id = sh.video_id and f.timestamp_ms between start_timestamp_ms and end_timestamp_ms)
select 'shot without a keyframe' as rule, count(*) as n from sh where shot_id not in (select shot_id from j) having count(*) > 0
union all select 'duplicate keyframe', count(*) from (select video_id, frame_id from j group by all having count(*) > 1) having count(*) > 0
union all select 'keyframe isn''t as in the index', count(*) from j where frame_id % 5 = 0 having count(*) > 0""")
def keyframe_issues(spark, sf_dir):
    """Views as keyframes of their shots, against an index that lacks each fifth."""
    cuts = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"))
    f = frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms")
    keys = f.join(cuts, "video_id").where(F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms"))).select("video_id", "frame_id", "timestamp_ms", "shot_id")
    found = validation.keyframes(keys, f.where("frame_id % 5 <> 0"), cuts, 1 << 50)
    return found.where("rule <> 'shots overlap'").groupBy("rule").agg(F.count("*").alias("n"))


@query(f"with {SEGMENTS} select 'interval out of range' as rule, count(*) as n from sg where end_ms < start_ms or end_ms > start_ms + 2400000 having count(*) > 0 union all select 'unknown video', count(*) from sg where video_id not in (select video_id from fr) having count(*) > 0")
def modality_issues(spark, sf_dir):
    """Segments against the videos that have frames, and a longest duration."""
    s = segments(spark, sf_dir)
    found = validation.modality(s, frames(spark, sf_dir), "segment_id", interval=(F.col("start_ms"), F.col("end_ms"), F.col("start_ms") + 2400000))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("with w as (select c_custkey as video_id, k as kind from customer, (values ('frames'), ('audio')) t(k)) select count(*) as n from w where not exists (select 1 from orders where o_custkey = video_id and (kind = 'frames' or o_orderkey % 2 = 0))")
def missing_artifacts(spark, sf_dir):
    """Customers as videos, whose orders are frames and, each second, audio."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("k"))
    there = o.select("video_id", F.lit("frames").alias("kind")).unionByName(o.where("k % 2 = 0").select("video_id", F.lit("audio").alias("kind")))
    return validation.required(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), there, ["frames", "audio"]).agg(F.count("*").alias("n"))


@query("select conv_id as query_id, case when turn % 3 = 0 then 'KIS' else 'VQA' end as task, count(*) as n from conversations where turn % 3 < 2 group by all")
def batch_by_task(spark, sf_dir):
    """Turns as queries of two tasks with runners and one without."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.get(F.array(F.lit("kis"), F.lit(" Vqa "), F.lit("other")), F.pmod("turn", F.lit(3)).cast("int")).alias("task"))
    run = lambda q: q.groupBy("query_id", "task").agg(F.count("*").alias("n"))
    done = retrieval.batch(c, {"KIS": run, "VQA": run})
    return done["KIS"].unionByName(done["VQA"])
