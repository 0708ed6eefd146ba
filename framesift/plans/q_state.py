"""Quality, state, source and evidence queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import text as X
from ..operators import evidence, quality, routing, state
from ..sources import readers, schemas
from .tables import EVENTS, SEGMENTS, events, frames, millis, query, read, scratch, segments

# ---------------------------------------------------------------- quality


def _issues(spark, sf_dir):
    o, l, c = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return [
        quality.duplicates(l, ["l_orderkey", "l_linenumber"], "P0"),
        quality.orphans(o.select(F.col("o_custkey").alias("c_custkey")), c.where("c_custkey % 10 <> 0"), ["c_custkey"], "P1"),
        quality.violations(l, (F.col("l_discount") <= 0.09) & (F.col("l_quantity") >= 1), F.col("l_orderkey"), "P2", "discount"),
    ]


_ISS = "iss as (select 'P0' as severity, 'duplicate key' as rule, cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) as key from lineitem group by l_orderkey, l_linenumber having count(*) > 1 union all select 'P1', 'unknown reference', cast(o_custkey as varchar) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0) union all select 'P2', 'discount', cast(l_orderkey as varchar) from lineitem where not (l_discount <= 0.09 and l_quantity >= 1))"


@query(f"with {_ISS} select severity, rule, key, count(*) as n from iss group by all")
def quality_issues(spark, sf_dir):
    """Issue rows of a key, a reference and a constraint rule."""
    a, b, c = _issues(spark, sf_dir)
    return a.unionByName(b).unionByName(c).groupBy("severity", "rule", "key").agg(F.count("*").alias("n"))


@query(f"with {_ISS} select count(*) filter (severity = 'P0') as p0, count(*) filter (severity = 'P1') as p1, count(*) filter (severity = 'P2') as p2, count(*) filter (severity = 'P0') = 0 as gate from iss")
def quality_report(spark, sf_dir):
    return quality.report(_issues(spark, sf_dir))


@query(f"with {_ISS} select severity, rule, count(*) as n from iss group by all")
def quality_by_rule(spark, sf_dir):
    return quality.by_rule(_issues(spark, sf_dir))


@query("select 'P0' as severity, 'key sets differ' as rule, cast(k as varchar) as key from ((select distinct l_orderkey as k from lineitem except select o_orderkey from orders) union all (select o_orderkey from orders except select l_orderkey from lineitem))")
def key_sets(spark, sf_dir):
    """Orders without lines, and lines without an order."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return quality.key_sets_differ(l.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), ["k"])


@query("select 'P0' as severity, 'values differ' as rule, cast(c_custkey as varchar) as key from customer left join supplier on s_suppkey = c_custkey where c_nationkey is distinct from s_nationkey or s_suppkey is null")
def value_mismatches(spark, sf_dir):
    """Customers whose nation isn't that of the supplier of the same number."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return quality.mismatches(c, s, ["k"], ["nation"])


@query("select 'orders' as name, (select count(*) from orders) as found, (select count(*) from orders) as n, true as ok union all select 'customer', (select count(*) from customer), 7, (select count(*) from customer) = 7")
def manifest_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    m = o.agg(F.lit("orders").alias("name"), F.count("*").alias("n")).unionByName(spark.createDataFrame([("customer", 7)], "name string, n long"))
    return quality.counts_match({"orders": o, "customer": read(spark, sf_dir, "customer")}, m)


# ---------------------------------------------------------------- state


@query(f"with {EVENTS} select video_id, max_by(event_type, struct_pack(a := timestamp_ms, b := event_id)) as event_type, max_by(value, struct_pack(a := timestamp_ms, b := event_id)) as value from ev group by video_id")
def latest_status(spark, sf_dir):
    """The last event of each user: an upsert replayed."""
    e = events(spark, sf_dir).select("video_id", "event_type", "value", "timestamp_ms", "event_id")
    return state.latest(e, ["video_id"], ["timestamp_ms", "event_id"]).select("video_id", "event_type", "value")


@query(f"with {EVENTS}, l as (select video_id, max_by(event_type, struct_pack(a := timestamp_ms, b := event_id)) as s, max_by(event_id, struct_pack(a := timestamp_ms, b := event_id)) as e from ev group by video_id), w as (select unnest(range(0, 160)) as video_id) select w.video_id, case when s is null then 'run:new' when e % 5 = 0 then 'run:changed' when s = 'purchase' and e % 3 <> 0 then 'skip:completed' when s = 'purchase' then 'run:corrupt' when s = 'error' then 'skip:failed' when s = 'signup' then 'skip:disabled' else 'run:interrupted' end as decision from w left join l using (video_id)")
def incremental_decision(spark, sf_dir):
    """What to do with each module, a user's last event being its status."""
    e = events(spark, sf_dir).select("video_id", "event_type", "event_id", "timestamp_ms")
    last = state.latest(e, ["video_id"], ["timestamp_ms", "event_id"])
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "disabled").otherwise("running")
    registry = last.select("video_id", status.alias("status"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("now").alias("fingerprint"), (F.col("event_id") % 3 != 0).alias("valid"))
    wanted = spark.range(160).select(F.col("id").alias("video_id"), F.lit("now").alias("wanted_fingerprint"))
    return state.decide(registry, wanted, ["video_id"]).select("video_id", "decision")


@query("select n_nationkey as k, case when n_nationkey < 10 then 'a' else 'b' end as origin from nation where n_nationkey < 20")
def insert_or_ignore(spark, sf_dir):
    """Tables of two runs as one; the first one's row of a key stays."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    return state.insert_or_ignore([n.where("k < 10").withColumn("origin", F.lit("a")), n.where("k between 5 and 19").withColumn("origin", F.lit("b"))], ["k"])


@query("select n_nationkey as k, case when n_nationkey between 5 and 19 then 'new' else 'old' end as origin from nation")
def upserted(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    return state.upsert(n.withColumn("origin", F.lit("old")), n.where("k between 5 and 19").withColumn("origin", F.lit("new")), ["k"])


@query("select p_partkey as k, p_size % 3 <> 0 as reuse from part")
def resume_split(spark, sf_dir):
    """Rows to do and rows to reuse by fingerprint."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("fingerprint"))
    cached = p.withColumn("fingerprint", F.when(F.col("fingerprint").cast("int") % 3 != 0, F.col("fingerprint")).otherwise("stale"))
    todo, reuse = state.pending(p, cached, ["k"])
    return todo.select("k", F.lit(False).alias("reuse")).unionByName(reuse.select("k", F.lit(True).alias("reuse")))


@query("select cast(s_suppkey as varchar) as path, 'changed' as reason from supplier where s_suppkey % 7 = 0 and s_suppkey <= 80 union all select cast(s_suppkey as varchar), 'new' from supplier where s_suppkey > 80")
def stale_sources(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_suppkey").alias("k"), F.sha2("s_name", 256).alias("sha256"))
    old = s.where("k <= 80").withColumn("sha256", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("sha256")))
    return state.stale(s, old)


@query("select event_type as status, count(*) as n from events group by all")
def status_summary(spark, sf_dir):
    return state.status_summary(read(spark, sf_dir, "events").withColumnRenamed("event_type", "status"))


@query("select user_id as run_id, case when bool_or(event_type = 'click' and value > 80) then 'running' when bool_or(event_type = 'error' and value > 60) then 'partial' when bool_and(value < 200) then 'validated' else 'completed' end as state from events group by user_id")
def run_states(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when((F.col("event_type") == "click") & (F.col("value") > 80), "running").when((F.col("event_type") == "error") & (F.col("value") > 60), "failed").otherwise("completed")
    return state.run_state(e.select(F.col("user_id").alias("run_id"), status.alias("status"), (F.col("value") < 200).alias("checksum_ok")))


def _session_events(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == 0, "start").when(F.col("turn") % 4 == 3, "undo").otherwise("refine")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("kind"), F.sha2("text", 256).alias("payload"))


@query("""with recursive e as (select conv_id as s, turn, case when turn = 0 then 'start' when turn % 4 = 3 then 'undo' else 'refine' end as kind, row_number() over (partition by conv_id order by turn) as i from conversations),
r as (select s, 0::bigint as i, 0 as n, 0 as revision, 0 as refused from (select distinct s from e) union all
select r.s, e.i, case when kind = 'refine' and n < 5 then n + 1 when kind = 'undo' and n > 0 then n - 1 when kind = 'start' then 0 else n end, case when (kind = 'refine' and n < 5) or kind = 'undo' then revision + 1 else revision end, case when kind = 'refine' and n >= 5 then refused + 1 else refused end from r join e on e.s = r.s and e.i = r.i + 1)
select s as session_id, max_by(n, i) as n_active, max_by(revision, i) as revision, max_by(refused, i) as refused from r group by s""")
def session_replay(spark, sf_dir):
    """Conversations replayed as feedback sessions."""
    return state.replay(_session_events(spark, sf_dir)).select("session_id", F.size("active").alias("n_active"), "revision", "refused")


@query("with e as (select user_id as s, cast(epoch_us(ts) // 1000 as bigint) as t, event_type as k from events), g as (select s, min(t) filter (k = 'signup') as a, min(t) filter (k = 'purchase') as c, min(t) filter (k = 'click') as r from e group by s) select s as session_id, case when r < c then 'feedback' else 'no_feedback' end as cohort, c - a as elapsed_ms from g where a is not null and c is not null")
def first_correct(spark, sf_dir):
    """From a user's first signup to the first purchase."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "click", "refine").otherwise("other")
    return state.first_correct(e.select(F.col("user_id").alias("session_id"), millis(F.col("ts")).alias("ts_ms"), kind.alias("kind")))


@query("select distinct user_id as session_id, event_type as revision, cast(floor(value) as bigint) % 3 as video_id, 0 as frame_id from events")
def confirmations(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("revision"), (F.floor("value").cast("long") % 3).alias("video_id"), F.lit(0).alias("frame_id"))
    return state.confirmations(e)


@query("select distinct user_id as run_id from events where event_type = 'error' and value > 90")
def active_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("run_id"), F.ceil("value").alias("expires_ms"))
    return state.active_runs(e, 90)


# ---------------------------------------------------------------- sources


@query("with f as (select doc_id, sha256(text) as h from documents), w as (select doc_id, first_value(doc_id) over (partition by h order by doc_id) as first, row_number() over (partition by h order by doc_id) as n from f) select doc_id as video_id, case when n > 1 then 'duplicate' else 'accepted' end as ingest_status, case when n > 1 then first end as duplicate_of_video_id from w")
def content_dedup(spark, sf_dir):
    """Documents as files: the first of a content is accepted, the others are its duplicates."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("length"))
    return readers.ingest(d).select("video_id", "ingest_status", "duplicate_of_video_id")


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 100 order by o_orderkey limit 50")
def keyset_page(spark, sf_dir):
    rows, _ = readers.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", readers.cursor("100"), 50)
    return rows


@query("select * from region where r_regionkey = 2")
def point_lookup(spark, sf_dir):
    return readers.point(read(spark, sf_dir, "region"), "r_regionkey", 2)


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F'")
def optional_filters(spark, sf_dir):
    return readers.filtered(read(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="F", l_tax=None).select("l_orderkey", "l_linenumber")


@query("select count(*) as n, count(distinct doc_id) as n_ids from documents")
def round_trip(spark, sf_dir):
    """Documents through every file format, back as many."""
    path = scratch(spark, "round")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    d.write.json(f"{path}.jsonl")
    a = readers.table(spark, f"{path}.jsonl", d.schema)
    a.write.parquet(f"{path}.parquet")
    return readers.table(spark, f"{path}.parquet").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))


@query("select n_name, cast(n_nationkey as bigint) as k from nation")
def json_payload(spark, sf_dir):
    """Records inside a JSON object."""
    path = scratch(spark, "payload")
    n = read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("k"))
    n.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("n_name", "k")).alias("records"))).alias("value")).write.text(path)
    return readers.json_payload(spark, path, T.StructType.fromDDL("n_name string, k long"))


# ---------------------------------------------------------------- scalars and evidence


@query(r"""select page_id, case when regexp_matches(url, '[?&]v=([A-Za-z0-9_-]{6,20})') then regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{6,20})', 1) else null end as video, true as has_stem, regexp_replace(regexp_extract(trim(url), '([^/\\]+)$', 1), '\.[^.]*$', '') as stem from pages""")
def url_aliases(spark, sf_dir):
    """What a page's address may name."""
    p = read(spark, sf_dir, "pages")
    v = S.alias_variants(F.col("url"))
    stem = F.regexp_replace(F.regexp_extract(F.trim("url"), r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return p.select("page_id", S.youtube_id(F.col("url")).alias("video"), (stem.isNotNull() & ((stem == "") | F.array_contains(v, stem))).alias("has_stem"), stem.alias("stem"))


@query("with a as (select p_partkey as record_id, p_name as a from part), l as (select p_name as alias, count(distinct p_brand) as n, min(p_brand) as v from part group by p_name) select record_id, case when n = 1 then 'matched' else 'ambiguous' end as status, case when n = 1 then v end as video_id from a join l on alias = a")
def metadata_match(spark, sf_dir):
    """Parts matched to a brand by their names, where a name has one."""
    p = read(spark, sf_dir, "part")
    records = p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"))
    lookup = p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("video_id"))
    return evidence.match_metadata(records, lookup, ["title"]).select("record_id", "status", "video_id")


@query("with a as (select p_partkey as record_id, p_name as a from part), l as (select p_name as alias, count(distinct p_brand) as n from part group by p_name) select case when n = 1 then 'matched' else 'ambiguous' end as status, count(*) as n from a join l on alias = a group by all")
def import_report(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    m = evidence.match_metadata(p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title")), p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("video_id")), ["title"])
    return evidence.import_report(m).select("status", "n")


@query(f"""with {SEGMENTS}, c as (select event_id as candidate_id, video_id, timestamp_ms as t from ev where event_type = 'purchase'),
f as (select c.candidate_id, count(*) as n from c join fr on fr.video_id = c.video_id and fr.timestamp_ms between greatest(0, t - 3600000) and t + 3600000 group by all),
s as (select c.candidate_id, count(*) as n from c join sg on sg.video_id = c.video_id and sg.start_ms <= t + 3600000 and sg.end_ms >= greatest(0, t - 3600000) group by all)
select candidate_id, coalesce(f.n, 0) as n_frames, coalesce(s.n, 0) as n_asr from c left join f using (candidate_id) left join s using (candidate_id)""")
def evidence_packs(spark, sf_dir):
    """Frames and speech within an hour of each candidate."""
    c = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("candidate_id"), "video_id", "timestamp_ms")
    e = segments(spark, sf_dir).select("video_id", F.lit("asr").alias("kind"), F.col("segment_id").alias("text"), "start_ms", "end_ms")
    out = evidence.evidence_pack(c, frames(spark, sf_dir), e, 3600000)
    n = lambda col: F.coalesce(F.when(F.col(col).isNotNull(), F.size(col)), F.lit(0)).cast("long")
    return out.select("candidate_id", n("frames").alias("n_frames"), n("asr").alias("n_asr"))


@query()
def vqa_answers(spark, sf_dir):
    """The first text near each candidate as its answer."""
    c = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("candidate_id"), "video_id", "timestamp_ms")
    e = segments(spark, sf_dir).select("video_id", F.lit("asr").alias("kind"), F.col("segment_id").alias("text"), "start_ms", "end_ms")
    return evidence.answer(evidence.evidence_pack(c, frames(spark, sf_dir), e, 3600000)).select("candidate_id", "answer", "verified", "manual")


@query(f"with {EVENTS} select event_id, sha256('{{\"a\":' || cast(event_id as varchar) || ',\"b\":\"' || event_type || '\"}}') as digest from ev")
def row_digests(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", S.row_digest(F.col("event_id").alias("a"), F.col("event_type").alias("b")).alias("digest"))


@query("select o_orderpriority, sha256(string_agg(sha256(cast(o_orderkey as varchar)), chr(10) order by o_orderkey)) as digest from orders group by o_orderpriority")
def ordered_digests(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(S.ordered_digest(F.sha2(F.col("o_orderkey").cast("string"), 256), F.col("o_orderkey")).alias("digest"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(round_even(l_partkey * 1001 * 1000 / 30000.0::decimal(20, 4), 0) as bigint) as ms, cast(floor(l_partkey * 1001 * 1000 / 30000.0::decimal(20, 4)) as bigint) as ms_floor from lineitem")
def pts_to_ms(spark, sf_dir):
    """Half-even rounding, and truncation."""
    l = read(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", S.pts_to_ms(F.col("l_partkey"), F.lit("1001/30000")).alias("ms"), S.pts_to_ms(F.col("l_partkey"), F.lit("1001/30000"), True).alias("ms_floor"))


@query("select s_suppkey, round(case when s_suppkey % 9 = 0 then null else (s_suppkey * 1.0 / (s_suppkey % 9)) end, 6) as ratio from supplier")
def fractions(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.round(S.fraction(F.concat_ws("/", F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 9).cast("string"))), 6).alias("ratio"))


@query("select conv_id, turn, regexp_matches(text, '(?i)\\b(text|sign|caption|written|banner|logo|title)\\b') as ocr, regexp_matches(text, '(?i)\\b(say|says|said|speak|speaks|voice|mentions)\\b') as asr from conversations")
def branch_routing(spark, sf_dir):
    """Branches that a turn's words add."""
    b = routing.branches(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_contains(b, "ocr").alias("ocr"), F.array_contains(b, "asr").alias("asr"))


@query(r"select conv_id, turn, len(list_filter(list_transform(string_split_regex(case when regexp_matches(text, '(?i)(sequence|events?|order|chuỗi|sự kiện|thứ tự)[^:]*:') then regexp_replace(text, '^[^:]*:', '') else text end, '\(\d+\)|;|\n'), lambda x: trim(x)), lambda x: x <> '')) as n_events from conversations")
def event_split(spark, sf_dir):
    """Parts of a list of events."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(routing.split_events(F.col("text"))).cast("long").alias("n_events"))


@query("select p_partkey, trim(regexp_replace(replace(lower(p_type), '_', ' '), '\\s+', ' ', 'g')) as label from part")
def label_forms(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.label(F.col("p_type")).alias("label"))


@query("select c_custkey, least(1.0, greatest(0.0, (c_acctbal / 10000)::double)) as p from customer")
def probabilities(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", S.probability((F.col("c_acctbal") / 10000).cast("string")).alias("p"))


@query("select l_orderkey, l_linenumber, least(1, (l_partkey % 700) / 640.0::double) as x1, least(1, (l_partkey % 700 + l_quantity::double) / 640.0::double) as x2, least(1, (l_suppkey % 500) / 480.0::double) as y1, least(1, (l_suppkey % 500 + l_quantity::double) / 480.0::double) as y2 from lineitem")
def unit_boxes(spark, sf_dir):
    """Boxes from pixels, clamped to the picture, with corners out of order."""
    a, b, w = (F.col("l_partkey") % 700).cast("double"), (F.col("l_suppkey") % 500).cast("double"), F.col("l_quantity").cast("double")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.box(a + w, b, a, b + w, F.lit(640.0), F.lit(480.0)).alias("b"))
    return l.select("l_orderkey", "l_linenumber", "b.x1", "b.x2", "b.y1", "b.y2")


@query("select name, length(name) > 0 as has_json from (values " + ", ".join(f"('{n}')" for n in sorted(schemas.SCHEMAS)) + ") t(name)")
def schema_export(spark, sf_dir):
    """Schemas whose JSON, read back, is the schema again."""
    same = [(n, T.StructType.fromJson(json.loads(j)) == T.StructType.fromDDL(schemas.SCHEMAS[n])) for n, j in schemas.exported().items()]
    return spark.createDataFrame(same, "name string, has_json boolean")


@query("select source, cast(null as varchar) as metadata_source, count(*) as n_documents from (select case when doc_id % 2 = 0 then 'ocr' else 'asr' end as source from documents) group by source")
def text_documents(spark, sf_dir):
    """Documents as text and speech evidence, as one table of text documents."""
    d = read(spark, sf_dir, "documents")
    ocr = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("detection_id"), F.col("text").alias("raw_text"), X.normalize_text(F.col("text")).alias("normalized_text"), X.folded_search_text(F.col("text")).alias("normalized_text_no_diacritics"), X.punctuation_aware(F.col("text")).alias("punctuation_aware_text"), X.stored_grams(F.col("text")).alias("character_ngrams"), F.lit(False).alias("below_threshold"), F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), F.col("doc_id").alias("timestamp_ms"))
    asr = d.where("doc_id % 2 = 1").select(F.col("doc_id").cast("string").alias("segment_id"), "text", X.normalize_text(F.col("text")).alias("normalized_text"), X.folded_search_text(F.col("text")).alias("normalized_text_no_diacritics"), F.col("source").alias("video_id"), F.col("doc_id").alias("start_ms"), F.col("doc_id").alias("end_ms"))
    return evidence.document_counts(evidence.all_documents(ocr, asr, None)).select("source", "metadata_source", "n_documents")

