"""Temporal queries: events are frames (views), probes (purchases), segments (clicks) and shots (signups) of users."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import policies, sequences, temporal
from .tables import EVENTS, FRAMES, PROBES, SEGMENTS, SHOTS, events, frames, media, probes, query, segments, shots

#: Shots last days here.
DAY = 86_400_000
_FT = "select video_id, timestamp_ms, min(frame_id) as first, max(frame_id) as last from fr group by all"


def _asof(pick: str) -> str:
    return f"""with {PROBES}, ft as ({_FT}), j as (select p.probe_id, p.t,
 max(struct_pack(ms := f.timestamp_ms, f := f.last)) filter (f.timestamp_ms <= p.t) as prev, min(struct_pack(ms := f.timestamp_ms, f := f.first)) filter (f.timestamp_ms >= p.t) as nxt,
 min(struct_pack(ms := f.timestamp_ms, f := f.first)) as lowest, max(struct_pack(ms := f.timestamp_ms, f := f.last)) as highest, min(f.first) filter (f.timestamp_ms = p.t) as exact
 from pr p join ft f using (video_id) group by all) select probe_id, {pick} from j"""


@query(_asof("cast(coalesce(exact, prev.f, lowest.f) as bigint) as before_frame, cast(coalesce(exact, nxt.f, highest.f) as bigint) as after_frame"))
def as_of_bracket(spark, sf_dir):
    """Frames before and after each probe, clamped to the first and last."""
    out = temporal.as_of(probes(spark, sf_dir), frames(spark, sf_dir)).where("nearest is not null")
    return out.select("probe_id", F.col("before.frame_id").alias("before_frame"), F.col("after.frame_id").alias("after_frame"))


@query(_asof("cast(coalesce(exact, case when nxt is null or (prev is not null and t - prev.ms <= nxt.ms - t) then prev.f else nxt.f end) as bigint) as frame_id, cast(case when exact is not null then 0 when nxt is null or (prev is not null and t - prev.ms <= nxt.ms - t) then t - prev.ms else nxt.ms - t end as bigint) as absolute_error_ms"))
def as_of_nearest(spark, sf_dir):
    """The nearest frame to each probe (the earlier of two) and its error."""
    return temporal.as_of_error(probes(spark, sf_dir), frames(spark, sf_dir)).where("frame_id is not null").select("probe_id", "frame_id", "absolute_error_ms")


@query(f"""with {SHOTS}, l as (select p.probe_id, max_by(s, s.start_timestamp_ms) as s, any_value(p.t) as t from pr p left join sh s on s.video_id = p.video_id and s.start_timestamp_ms <= p.t group by p.probe_id)
select probe_id, case when t <= s.end_timestamp_ms then s.shot_id end as shot_id from l""")
def point_in_shot(spark, sf_dir):
    """The last shot that starts before a probe, if it has not ended."""
    p = probes(spark, sf_dir).withColumn("shot_id", F.lit(None).cast("string"))
    return temporal.point_in_interval(p, shots(spark, sf_dir), "t").select("probe_id", "shot_id")


@query(f"with {SEGMENTS} select s.segment_id, count(f.frame_id) as n_frames, min(f.frame_id) as least, max(f.frame_id) as most from sg s left join fr f on f.video_id = s.video_id and f.timestamp_ms between s.start_ms and s.end_ms group by s.segment_id")
def segment_frames(spark, sf_dir):
    """Frames inside each segment."""
    out = temporal.contained_frames(segments(spark, sf_dir), frames(spark, sf_dir))
    return out.select("segment_id", F.size("frames").cast("long").alias("n_frames"), F.array_min("frames").alias("least"), F.array_max("frames").alias("most"))


@query(f"with {SEGMENTS} select f.frame_id, count(s.segment_id) as n_segments from fr f left join sg s on f.video_id = s.video_id and f.timestamp_ms between s.start_ms and s.end_ms group by f.frame_id")
def frame_segments(spark, sf_dir):
    """Segments that contain each frame."""
    return temporal.frame_segments(frames(spark, sf_dir), segments(spark, sf_dir)).select("frame_id", F.size("segments").cast("long").alias("n_segments"))


@query(f"with {SHOTS} select g.segment_id, count(s.shot_id) as n_shots, min(s.start_timestamp_ms) as first_start from sg g left join sh s on s.video_id = g.video_id and s.start_timestamp_ms <= g.end_ms and s.end_timestamp_ms >= g.start_ms group by g.segment_id")
def segment_shots(spark, sf_dir):
    """Shots that each segment overlaps."""
    s = shots(spark, sf_dir)
    out = temporal.overlapping_shots(segments(spark, sf_dir), s, DAY).select("segment_id", F.col("shots"))
    first = out.select("segment_id", F.get("shots", F.lit(0)).alias("shot_id")).join(s.select("shot_id", "start_timestamp_ms"), "shot_id", "left")
    return out.join(first.select("segment_id", F.col("start_timestamp_ms").alias("first_start")), "segment_id").select("segment_id", F.size("shots").cast("long").alias("n_shots"), "first_start")


@query(f"with {SEGMENTS} select t.segment_id as target_id, s.segment_id from sg t join sg s on s.video_id = t.video_id and s.end_ms >= greatest(0, t.start_ms - 600000) and s.start_ms <= t.end_ms + 600000")
def context_window(spark, sf_dir):
    """Segments around every segment, ten minutes to each side."""
    s = segments(spark, sf_dir)
    return temporal.context(s, s, 600000).select("target_id", "segment_id")


@query(f"with {FRAMES} select frame_id, lag(frame_id) over w as prev_frame_id, lead(frame_id) over w as next_frame_id, lag(timestamp_ms) over w as prev_timestamp_ms, lead(timestamp_ms) over w as next_timestamp_ms from fr window w as (partition by video_id order by timestamp_ms, frame_id)")
def neighbour_links(spark, sf_dir):
    return temporal.neighbours(frames(spark, sf_dir)).select("frame_id", "prev_frame_id", "next_frame_id", "prev_timestamp_ms", "next_timestamp_ms")


@query(f"""with {SEGMENTS}, ft as ({_FT}), ins as (select s.segment_id, count(f.frame_id) as n, min(f.frame_id) as lo, max(f.frame_id) as hi from sg s left join fr f on f.video_id = s.video_id and f.timestamp_ms between s.start_ms and s.end_ms group by s.segment_id),
br as (select s.segment_id, coalesce(max(struct_pack(ms := f.timestamp_ms, f := f.last)) filter (f.timestamp_ms <= s.start_ms), min(struct_pack(ms := f.timestamp_ms, f := f.first))).f as a, coalesce(min(struct_pack(ms := f.timestamp_ms, f := f.first)) filter (f.timestamp_ms >= s.end_ms), max(struct_pack(ms := f.timestamp_ms, f := f.last))).f as b from sg s join ft f using (video_id) group by s.segment_id)
select segment_id, case when n > 0 then n when a = b then 1 else 2 end as n_frames, cast(case when n > 0 then lo else least(a, b) end as bigint) as least, cast(case when n > 0 then hi else greatest(a, b) end as bigint) as most from ins join br using (segment_id)""")
def interval_keyframes(spark, sf_dir):
    """Frames inside each interval, or the bracket around an empty one."""
    out = temporal.interval_keyframes(segments(spark, sf_dir), frames(spark, sf_dir))
    return out.select("segment_id", F.size("frames").cast("long").alias("n_frames"), F.array_min("frames").alias("least"), F.array_max("frames").alias("most"))


@query(f"""with {SHOTS}, md as (select video_id, max(timestamp_ms) as duration_ms from ev group by video_id),
w as (select p.probe_id, p.video_id, greatest(0, t - 3600000) as start_ms, least(duration_ms, t + 3600000) as end_ms, (t - 3600000 < 0 or t + 3600000 > duration_ms) as clamped from pr p join md using (video_id))
select cast(w.probe_id as varchar) as segment_id, start_ms, end_ms, clamped, (select count(*) from sg s where s.video_id = w.video_id and s.start_ms <= w.end_ms and s.end_ms >= w.start_ms) as n_asr, (select count(*) from sh where sh.video_id = w.video_id and sh.start_timestamp_ms <= w.end_ms and sh.end_timestamp_ms >= w.start_ms) as n_shots from w""")
def window_by_radius(spark, sf_dir):
    """An hour around each probe, clamped to the media, with what lies in it."""
    r = probes(spark, sf_dir).select(F.col("probe_id").cast("string").alias("segment_id"), "video_id", "t", F.lit(3600000).alias("radius"))
    out = temporal.window_by_radius(r, frames(spark, sf_dir), shots(spark, sf_dir), segments(spark, sf_dir), media(spark, sf_dir), DAY)
    return out.select("segment_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "clamped", F.size("asr").cast("long").alias("n_asr"), F.size("shots").cast("long").alias("n_shots"))


@query(_asof("cast(coalesce(exact, case when nxt is null or (prev is not null and t - prev.ms <= nxt.ms - t) then prev.f else nxt.f end) as bigint) as frame_id, cast(greatest(0, t - 1500) as bigint) as window_start_ms"))
def canonical_candidates(spark, sf_dir):
    """Candidates snapped to their nearest frame, with a default window."""
    c = probes(spark, sf_dir).select(F.col("probe_id").alias("candidate_id"), "video_id", F.col("t").alias("timestamp_ms"), F.lit(None).cast("long").alias("window_start_ms"), F.lit(None).cast("long").alias("window_end_ms"), F.array(F.lit("asr")).alias("sources"))
    out = temporal.canonical(c, frames(spark, sf_dir), media(spark, sf_dir)).where("frame_id is not null")
    return out.select(F.col("candidate_id").alias("probe_id"), "frame_id", F.col("window_start_ms").cast("long").alias("window_start_ms"))


@query(f"""with {SEGMENTS}, o as (select s.segment_id, f.frame_id, cast(least(s.end_ms, f.timestamp_ms + 60000) - greatest(s.start_ms, f.timestamp_ms) as bigint) as overlap, row_number() over (partition by s.segment_id order by least(s.end_ms, f.timestamp_ms + 60000) - greatest(s.start_ms, f.timestamp_ms) desc, abs(f.timestamp_ms - (s.start_ms + s.end_ms) // 2), f.timestamp_ms, f.frame_id) as rank
 from sg s join fr f on f.video_id = s.video_id and f.timestamp_ms <= s.end_ms and f.timestamp_ms + 60000 >= s.start_ms) select segment_id, frame_id, overlap, rank from o""")
def overlap_ranked(spark, sf_dir):
    """Frames that last a minute, ranked for the segments they overlap."""
    f = frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms", F.col("timestamp_ms").alias("start"), (F.col("timestamp_ms") + 60000).alias("end"))
    s = segments(spark, sf_dir)
    out = temporal.overlap_ranked(s, f)
    touched = temporal.interval_join(s, f.select("video_id", F.col("start").alias("__a"), F.col("end").alias("__b")), ("start_ms", "end_ms"), ("__a", "__b")).select("segment_id").distinct()
    return out.join(touched, "segment_id", "left_semi").select("segment_id", "frame_id", "overlap", F.col("rank").cast("long").alias("rank"))


@query(f"with {PROBES}, e as (select event_id as other_id, video_id, timestamp_ms as u from ev) select p.probe_id as row_id, count(*) as n from pr p join e on e.video_id = p.video_id and abs(e.u - p.t) <= 300000 and e.other_id <> p.probe_id group by p.probe_id")
def near_in_time(spark, sf_dir):
    """Other events of a probe's video within five minutes."""
    r = probes(spark, sf_dir).withColumnRenamed("probe_id", "row_id")
    o = events(spark, sf_dir).select(F.col("event_id").alias("other_id"), "video_id", F.col("timestamp_ms").alias("other_t"))
    return temporal.near_in_time(r, o, 300000).groupBy("row_id").agg(F.count("*").alias("n"))


@query(f"""with {SHOTS}, md as (select video_id, max(timestamp_ms) as d from ev group by 1), s as (select segment_id, sg.video_id, start_ms, least(end_ms, d) as e from sg join md using (video_id) where start_ms <= d),
n as (select segment_id, min_by(frame_id, {{'a': abs(timestamp_ms - (start_ms + e) // 2), 't': timestamp_ms, 'f': frame_id}}) as representative_frame_id,
coalesce(max_by(frame_id, {{'t': timestamp_ms, 'f': frame_id}}) filter (timestamp_ms <= start_ms), min_by(frame_id, {{'t': timestamp_ms, 'f': frame_id}})) as before_frame_id,
coalesce(min_by(frame_id, {{'t': timestamp_ms, 'f': frame_id}}) filter (timestamp_ms >= e), max_by(frame_id, {{'t': timestamp_ms, 'f': frame_id}})) as after_frame_id,
count(*) filter (timestamp_ms between start_ms and e) as n_frames from s join fr using (video_id) group by 1),
k as (select segment_id, count(shot_id) as n_shots from s left join sh on sh.video_id = s.video_id and start_timestamp_ms <= e and end_timestamp_ms >= start_ms group by 1)
select segment_id, representative_frame_id, before_frame_id, after_frame_id, coalesce(n_frames, 0) as n_frames, n_shots from s left join n using (segment_id) join k using (segment_id)""")
def segment_links(spark, sf_dir):
    """Link rows of all segments."""
    s = segments(spark, sf_dir).join(media(spark, sf_dir), "video_id").where("start_ms <= duration_ms").drop("duration_ms")
    out = temporal.segment_links(s, frames(spark, sf_dir), shots(spark, sf_dir), media(spark, sf_dir), DAY)
    return out.select("segment_id", "representative_frame_id", "before_frame_id", "after_frame_id", F.size("frames").alias("n_frames"), F.size("shots").alias("n_shots"))


@query(f"""with {SEGMENTS}, w as (select segment_id, video_id, i - 1 as i, start_ms + (i - 1) * 600000 as t from sg, unnest(range(1, (greatest(start_ms, end_ms) - start_ms) // 600000 + 2)) u(i)),
n as (select segment_id, i, min_by(frame_id, {{'a': abs(timestamp_ms - t), 't': timestamp_ms, 'f': frame_id}}) as frame_id from w join fr using (video_id) group by 1, 2)
select segment_id, frame_id, min(i) as position from n group by 1, 2""")
def uniform_samples(spark, sf_dir):
    """A frame every ten minutes of each segment."""
    return temporal.uniform_samples(segments(spark, sf_dir), frames(spark, sf_dir), 600000).where("frame_id is not null")


@query(f"with {EVENTS}, md as (select video_id, max(timestamp_ms) as duration_ms from ev group by video_id) select cast(video_id as varchar) || ':' || cast(i as varchar) as probe_id, video_id, cast(floor(duration_ms * i / 6) as bigint) as t from md, unnest([1, 2, 3, 4, 5]) u(i)")
def decode_probes(spark, sf_dir):
    """Five equally spaced times of each video."""
    return temporal.equal_probes(media(spark, sf_dir))


@query(f"""with {SEGMENTS}, md as (select video_id, max(timestamp_ms) as d from ev group by 1), s as (select segment_id, sg.video_id, start_ms, least(end_ms, d) as e from sg join md using (video_id) where start_ms <= d),
n as (select fr.video_id, fr.frame_id, count(segment_id) as n from fr left join s on s.video_id = fr.video_id and timestamp_ms between start_ms and e group by 1, 2)
select video_id, frame_id, lag(frame_id) over w as prev_frame_id, lead(frame_id) over w as next_frame_id, n as n_segments from fr join n using (video_id, frame_id) window w as (partition by video_id order by timestamp_ms, frame_id)""")
def temporal_registry(spark, sf_dir):
    """Linked frames of the whole corpus."""
    s = segments(spark, sf_dir).join(media(spark, sf_dir), "video_id").where("start_ms <= duration_ms").drop("duration_ms")
    linked = temporal.registry(frames(spark, sf_dir), shots(spark, sf_dir), s, media(spark, sf_dir))["frames"]
    return linked.select("video_id", "frame_id", "prev_frame_id", "next_frame_id", F.size("segments").alias("n_segments"))


# ---------------------------------------------------------------- sequences


@query(f"with {EVENTS}, b as (select video_id, frame_id as start_frame_id, value as confidence from ev where event_type = 'signup'), l as (select video_id, max(frame_id) as last_frame_id from ev group by video_id) select b.video_id, cast(b.video_id as varchar) || ':shot:' || lpad(cast(row_number() over w - 1 as varchar), 6, '0') as shot_id, start_frame_id, cast(coalesce(lead(start_frame_id) over w - 1, last_frame_id) as bigint) as end_frame_id, lead(confidence) over w as confidence from b join l using (video_id) window w as (partition by b.video_id order by start_frame_id)")
def shots_from_starts(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.groupBy("video_id").agg(F.max("frame_id").alias("last_frame_id"))
    starts = e.where("event_type = 'signup'").select("video_id", F.col("frame_id").alias("start_frame_id"), F.col("value").alias("confidence")).join(last, "video_id")
    return sequences.shots_from_starts(starts)


@query(f"with {EVENTS}, n as (select video_id, value, row_number() over (partition by video_id order by timestamp_ms, event_id) - 1 as frame_id from ev), a as (select *, frame_id - row_number() over (partition by video_id order by frame_id) as island from n where value >= 10) select video_id, cast(max_by(frame_id, struct_pack(v := value, f := -frame_id)) as bigint) as frame_id, max(value) as score, count(*) as length from a group by video_id, island")
def score_runs(spark, sf_dir):
    """Runs of high values, as the highest of each."""
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "event_id")
    scores = events(spark, sf_dir).select("video_id", F.col("value").alias("score"), (F.row_number().over(w) - 1).cast("long").alias("frame_id"))
    return sequences.score_runs(scores, 10)


@query(f"""with {SEGMENTS}, m as (select *, max(end_ms) over (partition by video_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from sg),
g as (select *, sum(case when start_ms <= reach + 1800000 then 0 else 1 end) over (partition by video_id order by start_ms, end_ms rows unbounded preceding) as grp from m)
select video_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_spans from g group by video_id, grp""")
def merged_intervals(spark, sf_dir):
    """Segments merged over gaps of half an hour."""
    return sequences.merge_intervals(segments(spark, sf_dir), 1800000)


@query(f"with {SEGMENTS}, c as (select segment_id, video_id, start_ms, end_ms, case when end_ms - start_ms <= 300000 then 1 else cast(ceil((end_ms - start_ms - 30000) / 270000.0) as bigint) end as n from sg) select segment_id, cast(start_ms + i * 270000 as bigint) as start_ms, cast(least(end_ms, start_ms + i * 270000 + 300000) as bigint) as end_ms from c, unnest(range(0, n)) u(i)")
def split_intervals(spark, sf_dir):
    """Segments cut into five minutes with half a minute in common."""
    return sequences.split_intervals(segments(spark, sf_dir), 300000, 30000).select("segment_id", "start_ms", "end_ms")


@query(f"""with {SHOTS}, s as (select video_id, shot_id, start_timestamp_ms as a, end_timestamp_ms as b, end_timestamp_ms - start_timestamp_ms as d from sh), k as (select *, cast(ceil(d / 86400000.0) as bigint) as parts from s)
select distinct shot_id, t as anchor_ms, reason from (select shot_id, (a + b) // 2 as t, 'representative' as reason from k union all select shot_id, cast(a + floor(d * i / parts) as bigint), 'subdivision' from k, unnest(range(1, parts)) u(i) where parts > 1 union all select shot_id, a + 250, 'guard' from k where d > 500 union all select shot_id, b - 250, 'guard' from k where d > 500)""")
def anchors(spark, sf_dir):
    """Anchor times of shots, a day apart at most."""
    s = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"))
    return sequences.anchors(s, 86400000).select("shot_id", "anchor_ms", "reason")


@query(f"""with {SHOTS}, a as (select video_id, shot_id, start_timestamp_ms as a, end_timestamp_ms as b, (start_timestamp_ms + end_timestamp_ms) // 2 as anchor_ms from sh),
j as (select a.shot_id, f.frame_id, f.timestamp_ms as t, f.value - 0.25 * abs(f.timestamp_ms - anchor_ms) / 7200000 as score from a join fr f on f.video_id = a.video_id and abs(f.timestamp_ms - anchor_ms) <= 7200000 and f.timestamp_ms between a and b)
select shot_id, cast(max_by(frame_id, struct_pack(s := score, t := -t, f := -frame_id)) as bigint) as frame_id, round(max(score), 6) as score from j group by shot_id""")
def best_near_anchor(spark, sf_dir):
    """The best frame within two hours of each shot's middle."""
    s = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"), F.floor((F.col("start_timestamp_ms") + F.col("end_timestamp_ms")) / 2).alias("anchor_ms"), F.lit("representative").alias("reason"))
    return sequences.best_near_anchor(s, frames(spark, sf_dir).withColumnRenamed("value", "quality"), 7200000).select("shot_id", "frame_id", "score")


@query(f"with {EVENTS} select event_id, cast(timestamp_ms - first_value(timestamp_ms) over w as bigint) as timestamp_ms, cast(row_number() over w - 1 as bigint) as frame_id from ev window w as (partition by video_id order by timestamp_ms, event_id)")
def normalised_timeline(spark, sf_dir):
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "event_id")
    d = events(spark, sf_dir).drop("frame_id").withColumn("decode_index", F.row_number().over(w)).withColumnRenamed("timestamp_ms", "raw_timestamp_ms")
    return sequences.normalise_timeline(d).select("event_id", "timestamp_ms", "frame_id")


@query(f"with {FRAMES}, o as (select *, row_number() over (partition by video_id order by frame_id) - 1 as pos, lag(timestamp_ms) over (partition by video_id order by frame_id) as pt, lag(frame_id) over (partition by video_id order by timestamp_ms, frame_id) as pf from fr) select frame_id, case when timestamp_ms < pt then 'time runs back' when frame_id <= pf then 'frame id does not grow' else 'frame ids are not contiguous' end as fault from o where timestamp_ms < pt or frame_id <= pf or pos <> frame_id")
def order_faults(spark, sf_dir):
    return sequences.order_faults(frames(spark, sf_dir)).select("frame_id", "fault")


@query(f"with {FRAMES}, s as (select video_id, timestamp_ms - lag(timestamp_ms) over (partition by video_id order by timestamp_ms, frame_id) as d from fr), m as (select video_id, count(*) as n, median(d) filter (d > 0) as m, count(*) filter (d > 0) as k from s group by video_id), o as (select video_id, max(abs(d - m)) as o from s join m using (video_id) where d > 0 group by video_id) select video_id, coalesce(n >= 3 and k >= 2 and o > 1.5, false) as is_variable_frame_rate from m left join o using (video_id)")
def variable_rate(spark, sf_dir):
    return sequences.variable_rate(frames(spark, sf_dir))


@query(f"with {FRAMES}, r as (select *, row_number() over (partition by video_id order by timestamp_ms, frame_id) as r, count(*) over (partition by video_id) as n from fr) select video_id, frame_id from r where r = n // 2 + 1")
def middle_frame(spark, sf_dir):
    return sequences.middle_row(frames(spark, sf_dir)).select("video_id", "frame_id")


@query(f"with {SHOTS}, p as (select video_id, frame_id, row_number() over (partition by video_id order by timestamp_ms, frame_id) - 1 as position, count(*) over (partition by video_id) as n from fr), q as (select *, row_number() over (partition by video_id order by position) as r from p where position in (0, n // 2, n - 1)) select video_id, frame_id, position from q where r <= 7")
def audit_sample(spark, sf_dir):
    """First, middle and last frames of each video."""
    none = shots(spark, sf_dir).where("false").select("video_id", F.lit(0).cast("long").alias("start_frame_id"), F.lit(0).cast("long").alias("end_frame_id"))
    return sequences.audit_sample(frames(spark, sf_dir), none).select("video_id", "frame_id", F.col("position").cast("long").alias("position"))


@query(f"with {SHOTS}, u as (select sh.shot_id, f.timestamp_ms as t from sh join fr f on f.video_id = sh.video_id and f.timestamp_ms between sh.start_timestamp_ms and sh.end_timestamp_ms union all select shot_id, start_timestamp_ms from sh union all select shot_id, end_timestamp_ms from sh), g as (select shot_id, lead(t) over (partition by shot_id order by t) - t as gap from u) select shot_id, cast(coalesce(max(gap), 0) as bigint) as largest_gap_ms from g group by shot_id")
def largest_gap(spark, sf_dir):
    s = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"))
    f = temporal.interval_join(frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms"), s, ("timestamp_ms", "timestamp_ms"), ("start_ms", "end_ms"), width=DAY)
    return sequences.largest_gap(f.select("video_id", "shot_id", "timestamp_ms"), s).select("shot_id", "largest_gap_ms")


@query(f"with {SEGMENTS}, o as (select segment_id, start_ms, lag(segment_id) over w as prev_shot_id, lag(end_ms) over w as e from sg window w as (partition by video_id order by start_ms, end_ms, segment_id)) select segment_id as shot_id, prev_shot_id from o where start_ms < e")
def shot_overlaps(spark, sf_dir):
    """Segments that start before the one before has ended."""
    return sequences.shot_overlaps(segments(spark, sf_dir).withColumnRenamed("segment_id", "shot_id")).select("shot_id", "prev_shot_id")


@query(f"with {EVENTS} select event_id, 'e:' || cast(video_id as varchar) || ':' || cast(event_id as varchar) || ':' || cast(row_number() over (partition by video_id order by event_id, event_type, props) - 1 as varchar) as evidence_id from ev")
def evidence_ids(spark, sf_dir):
    """Ids by position over a video's rows."""
    e = events(spark, sf_dir).select("video_id", "frame_id", F.col("event_type").alias("bbox"), F.col("props").alias("normalized_text"), F.col("props").alias("raw_text"))
    return sequences.evidence_ranks(e, "e").select(F.col("frame_id").alias("event_id"), "evidence_id")


@query(f"with {EVENTS} select event_id, least(cast(floor(2000 + 6000 * (1 - case when value > 100 then 0.5 else value / 100 end)) as bigint), 3500) as radius from ev")
def adaptive_radius(spark, sf_dir):
    c = F.when(F.col("value") <= 100, F.col("value") / 100)
    return events(spark, sf_dir).select("event_id", S.adaptive_radius(c, budget=7000).cast("long").alias("radius"))


@query(f"""with recursive {EVENTS}, o as (select video_id, timestamp_ms as t, value as c, row_number() over (partition by video_id order by timestamp_ms) as n from ev),
r as (select video_id, n, t, c, 1 as g from o where n = 1
union all select o.video_id, o.n, case when o.t - r.t < 3600000 and o.c <= r.c then r.t else o.t end, case when o.t - r.t < 3600000 and o.c <= r.c then r.c else o.c end, case when o.t - r.t < 3600000 then r.g else r.g + 1 end from r join o on o.video_id = r.video_id and o.n = r.n + 1)
select video_id, max_by(t, n) as timestamp_ms, max_by(c, n) as confidence from r group by video_id, g""")
def boundary_suppression(spark, sf_dir):
    b = events(spark, sf_dir).select("video_id", "timestamp_ms", F.col("value").alias("confidence"))
    return sequences.suppress_boundaries(b, 3600000)


@query()
def perceptual_dedup(spark, sf_dir):
    f = events(spark, sf_dir).select("video_id", F.col("event_type").alias("shot_id"), "frame_id", "timestamp_ms", F.lit(0).alias("priority"), F.col("value").alias("quality"), (F.xxhash64("event_type") + F.col("event_id") % 7).alias("hash"))
    return sequences.perceptual_dedup(f, 3, 86400000).select("video_id", "frame_id")


@query()
def gap_filling(spark, sf_dir):
    s = shots(spark, sf_dir).select("video_id", "shot_id", F.col("start_timestamp_ms").alias("start_ms"), F.col("end_timestamp_ms").alias("end_ms"))
    f = temporal.interval_join(frames(spark, sf_dir).select("video_id", "frame_id", "timestamp_ms"), s, ("timestamp_ms", "timestamp_ms"), ("start_ms", "end_ms"), width=DAY).select("video_id", "shot_id", "frame_id", "timestamp_ms")
    first = f.groupBy("video_id", "shot_id").agg(F.min_by(F.struct("frame_id", "timestamp_ms"), F.struct("timestamp_ms", "frame_id")).alias("f")).select("video_id", "shot_id", "f.*")
    return sequences.fill_gaps(first, f, s, 86400000)


@query(f"""with recursive {EVENTS}, o as (select video_id, {{'s': timestamp_ms, 'e': timestamp_ms + 3600000, 'p': -value}} as x, row_number() over (partition by video_id order by timestamp_ms, -value) as n from ev where event_type = 'click'),
r as (select video_id, n, [x] as kept from o where n = 1
union all select video_id, n, case when k is null then list_append(kept, x) when x.p > kept[k].p then list_transform(kept, lambda y, i: case when i = k then x else y end) else kept end
from (select o.video_id, o.n, o.x, r.kept, list_min(list_filter(range(greatest(1, len(r.kept) - 3), len(r.kept) + 1), lambda i: (least(r.kept[i].e, o.x.e) - greatest(r.kept[i].s, o.x.s)) / 3600000.0 >= 0.5 or abs(r.kept[i].s - o.x.s) <= 500)) as k from r join o on o.video_id = r.video_id and o.n = r.n + 1)),
f as (select video_id, unnest(max_by(kept, n)) as x from r group by video_id)
select 'asr:' || cast(video_id as varchar) || ':' || lpad(cast(row_number() over (partition by video_id order by x.s, x.e) - 1 as varchar), 6, '0') as segment_id, x.s as start_ms, x.e as end_ms from f""")
def segment_dedup(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'click'").select("video_id", F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + 3600000).alias("end_ms"), F.col("event_type").alias("text"), (-F.col("value")).alias("avg_logprob"), F.lit(3).cast("long").alias("n_words"))
    return sequences.dedup_segments(e).select("segment_id", "start_ms", "end_ms")


@query(f"""with recursive {SEGMENTS}, o as (select video_id, start_ms, end_ms, row_number() over (partition by video_id order by start_ms, end_ms) as n from sg),
r as (select video_id, n, start_ms, end_ms, 1 as g, cast(0.5 as double) as c from o where n = 1
union all select o.video_id, o.n, o.start_ms, case when o.start_ms <= r.end_ms + 1800000 then greatest(r.end_ms, o.end_ms) else o.end_ms end, case when o.start_ms <= r.end_ms + 1800000 then r.g else r.g + 1 end, case when o.start_ms <= r.end_ms + 1800000 then (r.c + 0.5) / 2 else 0.5 end from r join o on o.video_id = r.video_id and o.n = r.n + 1)
select video_id, min(start_ms) as start_ms, max_by(end_ms, n) as end_ms, max_by(c, n) as confidence from r group by video_id, g""")
def merged_confidence(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("confidence", F.lit(0.5))
    return sequences.merge_confidence(s, 1800000)


@query(f"""with recursive {FRAMES}, o as (select video_id, frame_id, timestamp_ms, row_number() over (partition by video_id order by timestamp_ms, frame_id) as n from fr),
r as (select video_id, n, frame_id, timestamp_ms, timestamp_ms as last, true as taken from o where n = 1
union all select o.video_id, o.n, o.frame_id, o.timestamp_ms, case when o.timestamp_ms - r.last >= 3600000 then o.timestamp_ms else r.last end, o.timestamp_ms - r.last >= 3600000 from r join o on o.video_id = r.video_id and o.n = r.n + 1)
select video_id, frame_id, timestamp_ms from r where taken""")
def decimated_frames(spark, sf_dir):
    return sequences.decimate(frames(spark, sf_dir), 1 / 3600)


@query(f"""with {PROBES}, f as (select probe_id as request_id, t as c, fr.frame_id, timestamp_ms from pr join fr using (video_id) where timestamp_ms between t - 7200000 and t + 7200000),
co as (select * from (select *, row_number() over (partition by request_id, floor(timestamp_ms * (1.0::double / 1800) / 1000) order by timestamp_ms, frame_id) as r from f) where r = 1),
se as (select request_id, timestamp_ms as st from (select *, row_number() over (partition by request_id order by abs(timestamp_ms - c), timestamp_ms, frame_id) as k from co) where k <= 2),
nr as (select distinct f.* from f join se using (request_id) where abs(timestamp_ms - st) <= 1800000),
de as (select * from (select *, row_number() over (partition by request_id, floor(timestamp_ms * (1.0::double / 60) / 1000) order by timestamp_ms, frame_id) as r from nr) where r = 1),
g as (select request_id, frame_id, timestamp_ms, c, min(s) as stage from (select request_id, frame_id, timestamp_ms, c, 'coarse' as s from co union all select request_id, frame_id, timestamp_ms, c, 'dense' from de) group by all)
select request_id, frame_id, stage, rank from (select *, row_number() over (partition by request_id order by abs(timestamp_ms - c), timestamp_ms, frame_id) as rank from g) where rank <= 20""")
def two_stage_samples(spark, sf_dir):
    r = probes(spark, sf_dir).select(F.col("probe_id").alias("request_id"), "video_id", F.col("t").alias("center_ms"), F.lit(7200000).alias("radius"))
    return sequences.two_stage_sample(frames(spark, sf_dir), r, 1 / 1800, 1 / 60, 1800000, budget=20).select("request_id", "frame_id", "stage", "rank")


# ---------------------------------------------------------------- policies


def _scored(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("video_id").alias("group_id"), "frame_id", F.col("event_id").alias("pts"), "timestamp_ms", F.col("value").alias("score"), F.col("value").alias("visual_score"))


_W = "window w as (partition by video_id order by timestamp_ms, frame_id)"


@query(f"with {EVENTS} select frame_id, round(coalesce(abs(value - lag(value) over w) / greatest(1, timestamp_ms - lag(timestamp_ms) over w), 0), 9) as v from ev {_W}")
def policy_transition(spark, sf_dir):
    return _scored(spark, sf_dir).select("frame_id", F.round(policies.transition_score(F.col("score"), F.col("timestamp_ms")), 9).alias("v"))


@query(f"with {EVENTS} select frame_id, case when value >= coalesce(lag(value) over w, value) and value >= coalesce(lead(value) over w, value) then value else value - 1 end as v from ev {_W}")
def policy_peak(spark, sf_dir):
    return _scored(spark, sf_dir).select("frame_id", policies.peak_score(F.col("score")).alias("v"))


@query(f"with {EVENTS} select frame_id, round(avg(value) over x - 0.25 * coalesce(var_pop(value) over x, 0), 8) as v from ev window x as (partition by video_id order by timestamp_ms, frame_id rows between 1 preceding and 1 following)")
def policy_stable(spark, sf_dir):
    return _scored(spark, sf_dir).select("frame_id", F.round(policies.stable_score(F.col("score")), 8).alias("v"))


@query(f"with {EVENTS}, r as (select video_id as group_id, frame_id, value, row_number() over (partition by video_id order by value desc, abs(event_id - (select max_by(e2.event_id, struct_pack(a := e2.value, t := -e2.timestamp_ms, f := -e2.frame_id)) from ev e2 where e2.video_id = ev.video_id)), timestamp_ms, frame_id) as rank from ev) select group_id, frame_id, rank from r where rank <= 5")
def policy_ranking(spark, sf_dir):
    """The first five frames of each group."""
    return policies.rank_frames(_scored(spark, sf_dir), "representative", "KIS", 5).select("group_id", "frame_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {PROBES}, c as (select video_id as group_id, min_by(frame_id, timestamp_ms) as frame_id, min(timestamp_ms) as t from fr group by video_id), u as (select f.video_id as group_id, f.frame_id, abs(f.timestamp_ms - c.t) as d, 1 as k, f.timestamp_ms from fr f join c on c.group_id = f.video_id where f.frame_id <> c.frame_id union all select group_id, frame_id, 0, 0, t from c), r as (select *, row_number() over (partition by group_id order by k, d, timestamp_ms, frame_id) as rank from u) select group_id, frame_id, rank from r where rank <= 5")
def manual_ranking(spark, sf_dir):
    """Frames nearest to the coarse one, which comes first."""
    f = frames(spark, sf_dir).withColumnRenamed("video_id", "group_id")
    coarse = f.groupBy("group_id").agg(F.min_by("frame_id", "timestamp_ms").alias("frame_id"), F.min("timestamp_ms").alias("timestamp_ms"))
    return policies.manual_ranking(f, coarse).select("group_id", "frame_id", F.col("rank").cast("long").alias("rank"))
