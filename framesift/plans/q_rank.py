"""Ranking queries: fusion, vectors, objects, alignment and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import text as T
from ..operators import alignment, fusion, metrics, objects, vectors
from .tables import DETECTIONS, EVENTS, detections, events, query, read

_BR = f"{EVENTS}, br as (select event_type as branch, video_id, frame_id, timestamp_ms, value, row_number() over (partition by event_type order by value desc, event_id) as rank from ev), tb as (select *, case branch when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as branch_pos from br where rank <= 200)"


def _branches(spark, sf_dir):
    e = events(spark, sf_dir)
    pos = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 200").select(F.col("event_type").alias("branch"), pos.alias("branch_pos"), F.col("rank").alias("pos"), "video_id", "frame_id", "timestamp_ms", "rank", "value")


@query(f"with {_BR} select video_id, timestamp_ms // 86400000 as bucket, round(sum(case branch when 'error' then 0.5 else 1.0 end / (60 + rank)), 6) as score, min_by(frame_id, struct_pack(a := rank, b := branch_pos)) as frame_id, count(distinct branch) as n_branches from tb group by all")
def rrf_weighted_buckets(spark, sf_dir):
    """Branches fused by day; errors are the soft branch."""
    h = _branches(spark, sf_dir).withColumn("branch", F.when(F.col("branch") == "error", "object").otherwise(F.col("branch")))
    out = fusion.by_bucket(h, width=86400000)
    return out.select("video_id", F.col("bucket").cast("long").alias("bucket"), F.round("score", 6).alias("score"), "frame_id", F.size("branches").cast("long").alias("n_branches"))


@query(f"with {_BR}, u as (select video_id, cast(round(value) as bigint) as item, rank from tb), f as (select video_id, item as frame_id, sum(1.0 / (60 + rank)) as s, count(*) as n from u group by all) select video_id, frame_id, round(s, 6) as rrf_score, n as n_models from f order by s desc, n desc, video_id, frame_id limit 50")
def rrf_by_identity(spark, sf_dir):
    """Branches fused by item (a user's value), in order."""
    h = _branches(spark, sf_dir).select(F.concat_ws("-", "branch", "rank").alias("model"), "video_id", F.round("value").cast("long").alias("frame_id"), "rank", F.col("value").alias("similarity"))
    return fusion.by_identity(h).orderBy(*fusion.identity_order()).limit(50).select("video_id", "frame_id", F.round("rrf_score", 6).alias("rrf_score"), "n_models")


@query(f"with {_BR}, p as (select *, row_number() over (partition by video_id order by value desc, frame_id) as v from br), k as (select video_id, frame_id, value from p where v <= 5 order by value desc, frame_id limit 100) select video_id, frame_id, row_number() over (order by value desc, frame_id) as rank from k")
def capped_top(spark, sf_dir):
    """The best hundred with at most five of a video."""
    e = events(spark, sf_dir).select("video_id", "frame_id", F.col("value").alias("score"), F.col("event_id").alias("pos"))
    return fusion.cap_per_video(e).select("video_id", "frame_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_BR}, r as (select video_id, frame_id, rank from br where branch = 'view'), t as (select *, row_number() over (partition by video_id order by rank) as turn, min(rank) over (partition by video_id) as first from r) select video_id, frame_id, new_rank from (select *, row_number() over (order by turn, first) as new_rank from t) where new_rank <= 200")
def round_robin(spark, sf_dir):
    """One view of each user in turn."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    r = e.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).select(F.col("event_type").alias("query_id"), "video_id", "frame_id", "timestamp_ms", "rank")
    return fusion.round_robin(r, 200).select("video_id", "frame_id", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""with recursive {EVENTS}, tp as (select *, row_number() over (partition by event_type order by value desc, event_id) as rank from ev),
o as (select event_type as q, video_id, frame_id, timestamp_ms as t, rank, row_number() over (partition by event_type, video_id order by rank) as n from tp where rank <= 200),
r as (select q, video_id, n, frame_id, rank, [t] as kept, true as ok from o where n = 1
union all select o.q, o.video_id, o.n, o.frame_id, o.rank, case when len(list_filter(r.kept, lambda x: abs(x - o.t) <= 3600000)) = 0 then list_append(r.kept, o.t) else r.kept end, len(list_filter(r.kept, lambda x: abs(x - o.t) <= 3600000)) = 0 from r join o on o.q = r.q and o.video_id = r.video_id and o.n = r.n + 1),
k as (select *, row_number() over (partition by q, video_id order by rank) as turn, min(rank) over (partition by q, video_id) as f from r where ok)
select q as query_id, video_id, frame_id, new_rank from (select *, row_number() over (partition by q order by turn, f) as new_rank from k) where new_rank <= 50""")
def diversified(spark, sf_dir):
    """Near frames suppressed, then one of each video in turn, for each branch."""
    r = _branches(spark, sf_dir).select(F.col("branch").alias("query_id"), "video_id", "frame_id", "timestamp_ms", "rank")
    return fusion.diversify(r, 50, 3600000).select("query_id", "video_id", "frame_id", "new_rank")


@query("""with d as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), m as (select 'a' as model, vec_id, list_dot_product(v[1:32], (select v[1:32] from d where vec_id = 1)) as s from d union all select 'b', vec_id, list_dot_product(v[33:64], (select v[33:64] from d where vec_id = 1)) from d),
r as (select model, vec_id, row_number() over (partition by model order by s desc, vec_id) as rank from m) select vec_id as frame_id, round(sum(1.0 / (60 + rank)), 8) as score from r group by vec_id""")
def late_fusion(spark, sf_dir):
    """Complete rankings of two models (halves of the vectors), fused late."""
    e = read(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 1").select("embedding").first()[0]]
    parts = [e.select(F.lit(name).alias("model"), F.lit(0).alias("video_id"), F.col("vec_id").alias("frame_id"), S.dot(F.slice("embedding", lo + 1, 32), F.array(*map(F.lit, q[lo : lo + 32]))).alias("s")) for name, lo in (("a", 0), ("b", 32))]
    r = parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("s"), "frame_id")))
    return fusion.complete_late(r, models=2).select("frame_id", F.round("score", 8).alias("score"))


# ---------------------------------------------------------------- vectors

_V = "d as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@query(f"with {_V}, q as (select list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as q from d where vec_id = 0) select vec_id, round(list_dot_product(v, (select q from q)), 6) as similarity from d order by list_dot_product(v, (select q from q)) desc, vec_id limit 20")
def knn_exact(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]]
    return vectors.nearest(e, q, 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {_V}, s as (select q.vec_id as query_id, d.vec_id, list_dot_product(d.v, q.v) as s from d, d q where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from s) select query_id, vec_id, rank from r where rank <= 10")
def knn_each(spark, sf_dir):
    """The ten nearest of each query vector (every hundredth id)."""
    e = read(spark, sf_dir, "embeddings")
    return vectors.nearest_each(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_V}, q as (select v[1:32] as a, v[33:64] as b from d where vec_id = 2), m as (select 'first' as model, vec_id, label, list_dot_product(v[1:32], (select list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) from q)) as s from d union all select 'second', vec_id, label, list_dot_product(v[33:64], (select list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) from q)) from d),
r as (select *, row_number() over (partition by model order by s desc, vec_id) as rank from m), t as (select * from r where rank <= 200), g as (select label as video_id, vec_id as frame_id, sum(1.0 / (60 + rank)) as s, count(*) as n from t group by all)
select video_id, frame_id, round(s, 6) as rrf_score, n as n_models from g order by s desc, n desc, video_id, frame_id limit 30""")
def knn_multi_model(spark, sf_dir):
    """Two models' candidates fused by frame."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), F.lit(0).alias("timestamp_ms"), "embedding")
    q = [float(x) for x in e.where("vec_id = 2").select("embedding").first()[0]]
    half = lambda lo: e.withColumn("embedding", F.slice("embedding", lo + 1, 32))
    out, _ = vectors.multi_model({"first": half(0), "second": half(32)}, {"first": q[:32], "second": q[32:]}, 30)
    return out.select("video_id", "frame_id", F.round("rrf_score", 6).alias("rrf_score"), "n_models")


@query(f"with {_V}, l as (select label, i, avg(v[i]) as m from d, unnest(range(1, 65)) u(i) group by all), n as (select label, sqrt(sum(m * m)) as n from l group by label) select label, i - 1 as i, round(m / n, 6) as x from l join n using (label)")
def mean_vectors(spark, sf_dir):
    """The normalised mean vector of each label."""
    out = vectors.mean_vector(read(spark, sf_dir, "embeddings"), ["label"])
    return out.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"with {_V}, c as (select list_transform(list_zip((select v from d where vec_id = 0), (select v from d where vec_id = 1)), lambda p: 0.75 * p[1] + 0.25 * p[2]) as c), s as (select vec_id, label, list_dot_product(v, (select c from c)) / sqrt((select list_dot_product(c, c) from c)) as s from d), r as (select *, row_number() over (order by s desc, label, vec_id) as rank from s) select vec_id as frame_id, round(1.0 / (60 + rank), 8) as score from r")
def composed_rerank(spark, sf_dir):
    """A pool ranked by a composed query vector."""
    e = read(spark, sf_dir, "embeddings")
    a, b = ([float(x) for x in e.where(F.col("vec_id") == i).select("embedding").first()[0]] for i in (0, 1))
    pool = e.select(F.lit("m").alias("model"), F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), "embedding")
    return vectors.rerank(pool, {"m": (a, b)}).select("frame_id", F.round("score", 8).alias("score"))


@query(f"with {_V} select vec_id, 'not of unit length' as fault from (select vec_id, list_transform(v, lambda x: x * (1 + (vec_id % 50) * 0.00001)) as v from d) where abs(sqrt(list_dot_product(v, v)) - 1) > 0.0001")
def vector_faults(spark, sf_dir):
    """Vectors stretched a little; those beyond the tolerance."""
    e = read(spark, sf_dir, "embeddings")
    e = e.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + (F.col("vec_id") % 50) * 0.00001)))
    return vectors.faults(e, 64)


@query(f"""with d as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
m as (select 'a' as model, vec_id, label, list_dot_product(v[1:32], (select v[1:32] from d where vec_id = 3)) as s from d union all select 'b', vec_id, label, list_dot_product(v[33:64], (select v[33:64] from d where vec_id = 3)) from d),
r as (select *, row_number() over (partition by model order by s desc, vec_id) as rank from m),
g as (select label as video_id, vec_id as frame_id, sum(1.0::double / (60 + rank)) as s from r where rank <= 100 group by all having count(*) = 2)
select video_id, frame_id, round(s, 6) as rrf_score, row_number() over (order by s desc, video_id, frame_id) as rank from g""")
def feedback_pool(spark, sf_dir):
    """Two models' first hundred hits as one pool."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), "embedding")
    q = [float(x) for x in e.where("vec_id = 3").select("embedding").first()[0]]
    ranked = {n: e.withColumn("similarity", S.dot(F.slice("embedding", lo + 1, 32), F.array(*map(F.lit, q[lo : lo + 32])))).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id"))) for n, lo in (("a", 0), ("b", 32))}
    return vectors.feedback_pool(ranked, 100).select("video_id", "frame_id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query("select part.p_partkey as id, cast(bit_count(xor(part.p_partkey * 7919, part.p_size * 104729)) as bigint) as bits from part")
def hamming_distance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), S.hamming(F.col("p_partkey") * 7919, F.col("p_size").cast("long") * 104729).cast("long").alias("bits"))


# ---------------------------------------------------------------- objects


@query(f"with {DETECTIONS}, b as (select *, confidence < 0.25 as low from det) select frame_id, canonical_label, count(*) filter (not low) as count_in_frame, count(*) as raw_count_in_frame from b group by all")
def object_counts(spark, sf_dir):
    """Counts of a frame's labels, above the threshold and in all."""
    out = objects.count_in_frame(objects.flag(detections(spark, sf_dir)))
    return out.select("frame_id", "canonical_label", "count_in_frame", "raw_count_in_frame").distinct()


@query(f"with {DETECTIONS} select detection_id, (case when y < 1/3 then 'top' when y < 2/3 then 'middle' else 'bottom' end) || '_' || (case when x < 1/3 then 'left' when x < 2/3 then 'center' else 'right' end) as region from det")
def region_grid(spark, sf_dir):
    return detections(spark, sf_dir).select("detection_id", S.region(F.col("x"), F.col("y")).alias("region"))


@query(f"with {DETECTIONS} select distinct a.frame_id from det a join det b using (video_id, frame_id) where a.canonical_label = 'no' and b.canonical_label = 'ro' and a.x < b.x union all select distinct a.frame_id from det a join det b using (video_id, frame_id) where a.canonical_label = 'af' and b.canonical_label = 'rf' and a.y > b.y")
def relation_exists(spark, sf_dir):
    """Frames with one label left of another, and with one below another."""
    d = detections(spark, sf_dir)
    return objects.related(d, "no", "ro", "left_of").select("frame_id").unionByName(objects.related(d, "af", "rf", "below").select("frame_id"))


@query(f"with {DETECTIONS}, r as (select detection_id, row_number() over (partition by frame_id order by confidence desc nulls last, position) as r from det) select detection_id from r where r <= 2")
def object_truncation(spark, sf_dir):
    return objects.truncate(detections(spark, sf_dir), 2).select("detection_id")


@query(f"with {DETECTIONS} select canonical_label, min(detection_id) as row_id, count(*) as n from det group by canonical_label")
def label_representatives(spark, sf_dir):
    return objects.representatives(detections(spark, sf_dir).withColumn("row_id", F.col("detection_id"))).select("canonical_label", "row_id", "n")


@query(f"with {DETECTIONS} select detection_id from det where confidence >= 0.5 and detection_id in (select detection_id from det where canonical_label in ('af', 'rf'))")
def object_filter(spark, sf_dir):
    """By confidence and by aliases."""
    d = objects.flag(detections(spark, sf_dir)).withColumn("label_aliases", F.array(F.concat(F.lit("kind_"), "label")))
    return objects.filter_objects(d, objects.alias_table(d), ["kind af", "kind rf"], 0.5).select("detection_id")


@query(f"""with {DETECTIONS}, k as (select * from det where confidence >= 0.25), g as (select video_id, frame_id, count(distinct canonical_label) filter (canonical_label in ('af', 'rf')) as m, max(confidence) filter (canonical_label in ('af', 'rf')) as b, count(*) filter (canonical_label = 'af') as n from k group by all)
select video_id, frame_id, round(2.0 * m / 2 + 0.5 * coalesce(b, 0) + case when n = 2 then 1.5 else -0.5 end, 6) as score from g where m > 0 and 2.0 * m / 2 + 0.5 * coalesce(b, 0) + case when n = 2 then 1.5 else -0.5 end > 0""")
def object_scores(spark, sf_dir):
    """Frames scored for "two af and rf"."""
    q = objects.parse_query("two af and rf", {"af": "af", "rf": "rf"})
    return objects.frame_scores(objects.flag(detections(spark, sf_dir)), q).select("video_id", "frame_id", F.round("score", 6).alias("score"))


@query(f"with {DETECTIONS}, b as (select frame_id, max(confidence) as c from det where canonical_label = 'af' group by frame_id) select o_orderkey as frame_id, least(0.25, coalesce(c, 0) * 0.25) as boost from orders left join b on frame_id = o_orderkey")
def object_boost(spark, sf_dir):
    c = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 64).alias("video_id"), F.col("o_orderkey").alias("frame_id"))
    return objects.candidate_boost(c, detections(spark, sf_dir), ["af"]).select("frame_id", "boost")


# ---------------------------------------------------------------- alignment


def _pools(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')")
    k = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return e.select(F.col("video_id").alias("query_id"), k.cast("long").alias("event_index"), F.col("event_id").alias("pos"), "video_id", "frame_id", "timestamp_ms", F.col("value").alias("score"))


@query(f"""with {EVENTS}, p as (select video_id as q, case event_type when 'view' then 0 when 'click' then 1 else 2 end as k, event_id, timestamp_ms as t, value as s, row_number() over (partition by video_id, event_type order by value desc, event_id) as r from ev where event_type in ('view', 'click', 'purchase')), c as (select * from p where r <= 20)
select a.q as query_id, round(max(a.s + b.s + d.s), 6) as score from c a join c b on a.q = b.q and a.k = 0 and b.k = 1 and a.t <= b.t join c d on d.q = b.q and d.k = 2 and b.t <= d.t group by a.q""")
def trake_best_sum(spark, sf_dir):
    """The best sum of view, click and purchase in order, for each user."""
    return alignment.best_sum(_pools(spark, sf_dir), 3).select("query_id", F.round("score", 6).alias("score"))


@query(f"""with {EVENTS}, p as (select video_id as q, case event_type when 'view' then 0 when 'click' then 1 else 2 end as k, event_id, timestamp_ms as t, value as s, row_number() over (partition by video_id, event_type order by value desc, event_id) as r from ev where event_type in ('view', 'click', 'purchase')), c as (select * from p where r <= 20)
select a.q as query_id, round(max(a.s + b.s + d.s), 6) as score from c a join c b on a.q = b.q and a.k = 0 and b.k = 1 and a.t <= b.t join c d on d.q = b.q and d.k = 2 and b.t <= d.t group by a.q""")
def trake_dp(spark, sf_dir):
    """The same by the aligner's own fold."""
    out = alignment.align(_pools(spark, sf_dir), method="dp")
    return out.groupBy("query_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query(f"""with {EVENTS}, p as (select video_id as q, case event_type when 'view' then 0 when 'click' then 1 else 2 end as k, event_id as f, timestamp_ms as t, value as s, row_number() over (partition by video_id, event_type order by value desc, event_id) as r from ev where event_type in ('view', 'click', 'purchase')),
c as (select * from p where r <= 20), a as (select * from c where k = 0), b as (select * from c where k = 1), d as (select * from c where k = 2),
x as (select a.q, [a.f, b.f, d.f] as fs, a.s + b.s + d.s as v, row_number() over (partition by a.q order by a.s + b.s + d.s desc, d.r, b.r, a.r) as n from a join b on a.q = b.q and a.t <= b.t join d on d.q = b.q and b.t <= d.t),
g1 as (select a.q, a.f as f0, a.t as t0, a.s as s0, coalesce(min_by({{'f': b.f, 't': b.t, 's': b.s}}, b.r) filter (b.t >= a.t), min_by({{'f': b.f, 't': b.t, 's': b.s}}, b.r)) as y from a join b on a.q = b.q where a.r = 1 group by all),
g2 as (select g1.q, f0, s0, y, coalesce(min_by({{'f': d.f, 's': d.s}}, d.r) filter (d.t >= y.t), min_by({{'f': d.f, 's': d.s}}, d.r)) as z from g1 join d on g1.q = d.q group by all),
h as (select q, fs, v, 'dp' as method from x where n = 1 union all select q, [f0, y.f, z.f], s0 + y.s + z.s, 'greedy' from g2 where q not in (select q from x))
select q as query_id, array_to_string(fs, ',') as frames, round(v, 6) as score, method, fs[1] < fs[2] and fs[2] < fs[3] as valid from h""")
def trake_hypotheses(spark, sf_dir):
    """Full hypotheses, with the greedy way where there is no full path."""
    return alignment.hypotheses(alignment.align(_pools(spark, sf_dir))).select("query_id", F.array_join("frames", ",").alias("frames"), F.round("aggregate_score", 6).alias("score"), "method", "valid")


# ---------------------------------------------------------------- metrics

_QR = f"{EVENTS}, qs as (select distinct video_id as query_id from ev), rk as (select video_id as query_id, event_id as item, row_number() over (partition by video_id order by value desc, event_id) as rank from ev), rel as (select video_id as query_id, event_id as item from ev where event_type = 'purchase' and value > 50), fr1 as (select query_id, min(rank) as r from rk join rel using (query_id, item) group by query_id), fst as (select query_id, r from qs left join fr1 using (query_id))"


def _first(spark, sf_dir):
    e = events(spark, sf_dir)
    w = Window.partitionBy("video_id").orderBy(F.desc("value"), "event_id")
    ranking = e.select(F.col("video_id").alias("query_id"), F.col("event_id").alias("item"), F.row_number().over(w).alias("rank"))
    relevant = e.where("event_type = 'purchase' and value > 50").select(F.col("video_id").alias("query_id"), F.col("event_id").alias("item"))
    return metrics.first_relevant(e.select(F.col("video_id").alias("query_id")), ranking, relevant, "item"), ranking, relevant


@query(f"with {_QR} select count(*) as n_queries, " + ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0.0 end), 6) as hit_at_{k}" for k in metrics.CUTOFFS) + ", round(avg(coalesce(1.0 / r, 0)), 6) as mrr from fst")
def hit_and_mrr(spark, sf_dir):
    out = metrics.hit_and_mrr(_first(spark, sf_dir)[0])
    return out.select("n_queries", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"with {_QR} select round(avg((" + " + ".join(f"case when r <= {k} then 1.0 else 0.0 end" for k in metrics.CUTOFFS) + ") / 5), 6) as final_score from fst")
def final_score(spark, sf_dir):
    return metrics.final_score(_first(spark, sf_dir)[0]).select(F.round("final_score", 6).alias("final_score"))


@query(f"with {_QR}, a as (select distinct query_id from rel) select " + ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0.0 end), 6) as hit_at_{k}" for k in (1, 5, 20)) + " from a left join fr1 using (query_id)")
def frame_hits(spark, sf_dir):
    _, ranking, relevant = _first(spark, sf_dir)
    v = lambda d: d.withColumns({"video_id": F.lit(0), "frame_id": F.col("item")})
    out = metrics.frame_hits(v(ranking), v(relevant))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("with b as (select replace(strip_accents(lower(text)), 'ß', 's') as t from benchmark) select round(sum(levenshtein(t, substr(t, 4)))::double / sum(greatest(1, length(t))), 6) as cer from b")
def character_error_rate(spark, sf_dir):
    t = F.replace(T.fold(F.lower("text")), F.lit("ß"), F.lit("s"))
    p = read(spark, sf_dir, "benchmark").select(t.alias("t")).select(F.col("t").alias("expected"), F.expr("substring(t, 4)").alias("actual"))
    return metrics.character_error_rate(p).select(F.round("cer", 6).alias("cer"))


@query()
def word_error_rate(spark, sf_dir):
    p = read(spark, sf_dir, "benchmark").select(F.col("text").alias("expected"), F.expr("substring(text, 9)").alias("actual"))
    return metrics.word_error_rate(p).select(F.round("wer", 6).alias("wer"))


@query("select event_type, count(value) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, median(value) as median, round(avg(value), 6) as mean, max(value) as max from events group by event_type")
def latency_percentiles(spark, sf_dir):
    out = metrics.latency_summary(read(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumn("mean", F.round("mean", 6))


@query("with x as (select quantile_disc(case when event_type = 'view' then value end, 0.5) as baseline_p50, quantile_disc(case when event_type = 'view' then value end, 0.95) as baseline_p95, quantile_disc(case when event_type = 'click' then value end, 0.5) as refined_p50, quantile_disc(case when event_type = 'click' then value end, 0.95) as refined_p95 from events) select *, round(refined_p50 - baseline_p50, 6) as delta_p50, round(refined_p95 - baseline_p95, 6) as delta_p95 from x")
def latency_delta(spark, sf_dir):
    out = metrics.latency_delta(read(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms")), "view", "click")
    return out.withColumns({c: F.round(c, 6) for c in ("delta_p50", "delta_p95")})


@query(f"with {EVENTS}, s as (select event_type as run, video_id as query_id, timestamp_ms as t, row_number() over (partition by event_type, video_id order by value desc, event_id) as rank from ev), l as (select video_id as query_id, min(timestamp_ms) as a, min(timestamp_ms) + 864000000 as b from ev group by video_id), h as (select run, query_id, min(rank) as r from s join l using (query_id) where t between a and b group by all), q as (select distinct run, query_id from s) select run, round(avg(case when r <= 1 then 1.0 else 0.0 end), 6) as hit_at_1, round(avg(case when r <= 5 then 1.0 else 0.0 end), 6) as hit_at_5 from q left join h using (run, query_id) group by run")
def interval_hits(spark, sf_dir):
    e = events(spark, sf_dir)
    w = Window.partitionBy("event_type", "video_id").orderBy(F.desc("value"), "event_id")
    s = e.select(F.col("event_type").alias("run"), F.col("video_id").alias("query_id"), "video_id", "timestamp_ms", F.row_number().over(w).alias("rank"))
    l = e.groupBy(F.col("video_id").alias("query_id"), "video_id").agg(F.min("timestamp_ms").alias("start_ms"), (F.min("timestamp_ms") + 864000000).alias("end_ms"))
    out = metrics.interval_hits(s, l)
    return out.select("run", F.round("hit_at_1", 6).alias("hit_at_1"), F.round("hit_at_5", 6).alias("hit_at_5"))


@query("select case when user_id % 2 = 0 then 'feedback' else 'no_feedback' end as cohort, count(*) as n, min(cast(floor(value) as bigint)) as least from events where event_type = 'purchase' group by all")
def cohort_samples(spark, sf_dir):
    s = events(spark, sf_dir).where("event_type = 'purchase'").select(F.when(F.col("video_id") % 2 == 0, "feedback").otherwise("no_feedback").alias("cohort"), F.floor("value").cast("long").alias("elapsed_ms"))
    return metrics.cohort_samples(s).select("cohort", F.size("samples").cast("long").alias("n"), F.get("samples", F.lit(0)).alias("least"))
