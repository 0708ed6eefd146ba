"""Evidence rows to text documents, hits to candidates, metadata to videos, and evidence packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import text as T
from .temporal import BUCKET, as_of, interval_join

VQA_WINDOW, VQA_ANSWERS = 3000, 5


# ---------------------------------------------------------------- documents


def ocr_documents(ocr: DataFrame, keep_low: bool = False) -> DataFrame:
    grams = F.when(F.size("character_ngrams") > 0, F.col("character_ngrams")).otherwise(T.padded_grams(F.col("raw_text")))
    fields = F.create_map(F.lit("ocr_text"), F.col("normalized_text"), F.lit("ocr_no_diacritics"), F.col("normalized_text_no_diacritics"), F.lit("ocr_punctuation"), F.col("punctuation_aware_text"), F.lit("ocr_char_ngrams"), F.array_join(grams, T.GRAM_SEPARATOR))
    return ocr.where(F.lit(keep_low) | ~F.coalesce("below_threshold", F.lit(False))).select(F.col("detection_id").alias("doc_id"), F.lit("ocr").alias("source"), F.col("raw_text").alias("text"), fields.alias("fields"), F.to_json(F.struct("video_id", "frame_id", "timestamp_ms")).alias("metadata"))


def asr_documents(asr: DataFrame) -> DataFrame:
    fields = F.create_map(F.lit("asr_text"), F.col("normalized_text"), F.lit("asr_no_diacritics"), F.col("normalized_text_no_diacritics"), F.lit("asr_char_ngrams"), F.array_join(T.padded_grams(F.col("text")), T.GRAM_SEPARATOR))
    return asr.select(F.col("segment_id").alias("doc_id"), F.lit("asr").alias("source"), "text", fields.alias("fields"), F.to_json(F.struct("video_id", "start_ms", "end_ms")).alias("metadata"))


def metadata_documents(metadata: DataFrame) -> DataFrame:
    searchable = F.concat_ws(" ", "title", "description", F.array_join("tags", " "), "channel", "text")
    prefix = F.when(F.col("source") == "user_annotation", "annotation").otherwise("metadata")
    e = lambda c: F.coalesce(c, F.lit(""))
    entries = F.array(*(F.struct(F.concat_ws("_", prefix, F.lit(n)).alias("k"), e(v).alias("v")) for n, v in (("title", F.col("title")), ("description", F.col("description")), ("tags", F.array_join("tags", " ")), ("channel", F.col("channel")), ("text", F.col("text")), ("no_diacritics", T.folded_search_text(searchable)), ("char_ngrams", F.array_join(T.padded_grams(searchable), T.GRAM_SEPARATOR)))))
    return metadata.where(F.trim(searchable) != "").select(F.col("metadata_id").alias("doc_id"), F.lit("metadata").alias("source"), searchable.alias("text"), F.map_from_entries(entries).alias("fields"), F.to_json(F.struct("video_id", F.col("source").alias("metadata_source"))).alias("metadata"))


def all_documents(ocr: DataFrame | None, asr: DataFrame | None, metadata: DataFrame | None) -> DataFrame:
    """The documents of all modalities."""
    parts = [f(t) for f, t in ((ocr_documents, ocr), (asr_documents, asr), (metadata_documents, metadata)) if t is not None]
    return reduce(DataFrame.unionByName, parts)


def document_counts(documents: DataFrame) -> DataFrame:
    """Counts by source and by metadata source, and the number of field names."""
    kind = F.get_json_object("metadata", "$.metadata_source")
    return documents.groupBy("source", kind.alias("metadata_source")).agg(F.count("*").alias("n_documents"), F.size(F.array_distinct(F.flatten(F.collect_set(F.map_keys("fields"))))).alias("n_fields"))


def flat_documents(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One concatenated text for each row."""
    return rows.select(F.col(key).alias("doc_id"), F.concat_ws(" ", *columns).alias("text"))


# ---------------------------------------------------------------- hits


def hits_to_candidates(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """hits (doc_id, source, video_id, frame_id, timestamp_ms, start_ms, end_ms, score, rank) as candidates: OCR is its own frame, ASR the
    frame nearest to its middle with its window, metadata the video's middle frame and not submittable."""
    spoken = as_of(hits.where("source = 'asr'").select(F.col("doc_id").alias("probe_id"), "video_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("t")), frames).select(F.col("probe_id").alias("doc_id"), F.col("nearest").alias("near"))
    from .sequences import middle_row

    middle = middle_row(frames.select("video_id", "frame_id", "timestamp_ms")).select("video_id", F.col("frame_id").alias("__m"), F.col("timestamp_ms").alias("__mt"))
    h = hits.join(spoken, "doc_id", "left").join(middle, "video_id", "left")
    frame = F.when(F.col("source") == "asr", F.col("near.frame_id")).when(F.col("source") == "metadata", F.col("__m")).otherwise(F.col("frame_id"))
    time = F.when(F.col("source") == "asr", F.col("near.timestamp_ms")).when(F.col("source") == "metadata", F.col("__mt")).otherwise(F.col("timestamp_ms"))
    return h.select("doc_id", "source", "video_id", frame.alias("frame_id"), time.alias("timestamp_ms"), F.when(F.col("source") == "asr", F.col("start_ms")).alias("window_start_ms"), F.when(F.col("source") == "asr", F.col("end_ms")).alias("window_end_ms"), "score", "rank", (F.col("source") != "metadata").alias("submittable"), (F.col("source") == "metadata").alias("localization_required"))


def reference(source: Column) -> Column:
    """Names of the id and text columns of a source."""
    return F.when(source == "ocr", F.array(F.lit("detection_id"), F.lit("raw_text"))).when(source == "asr", F.array(F.lit("segment_id"), F.lit("text"))).when(source == "object", F.array(F.lit("detection_id"), F.lit("label"))).otherwise(F.array(F.lit("metadata_id"), F.lit("text")))


def ranked_rows(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of ranked ids (doc_id, rank), in the order of the ranks."""
    return documents.join(F.broadcast(ids), "doc_id").orderBy("rank")  # ids of a limit


def known_fields(row: Column, schema: str) -> Column:
    """The known fields of a JSON object."""
    return F.from_json(row, schema)


def scalar_fields(fields: Column) -> Column:
    """Entries that are scalars, without the caption."""
    return F.map_filter(fields, lambda k, v: (k != "caption") & ~v.rlike(r"^\s*[\[{]"))


# ---------------------------------------------------------------- metadata


def match_metadata(records: DataFrame, lookup: DataFrame, fields: list[str]) -> DataFrame:
    """records (record_id, fields...) with the video of the first alias, by field then variant, that names exactly one video of
    lookup (alias, video_id): matched, ambiguous (an alias names several and none one) or unmatched."""
    named = F.array(*(F.struct(F.lit(i).alias("field_pos"), F.col(c).alias("v")) for i, c in enumerate(fields)))
    exploded = records.select("record_id", F.explode(named).alias("f")).where("f.v is not null").select("record_id", "f.field_pos", F.posexplode(S.alias_variants(F.col("f.v"))).alias("alias_pos", "alias"))
    videos = lookup.groupBy("alias").agg(F.countDistinct("video_id").alias("n"), F.min("video_id").alias("video_id"))
    met = exploded.join(videos, "alias")
    best = met.groupBy("record_id").agg(F.min_by("video_id", F.when(F.col("n") == 1, F.struct("field_pos", "alias_pos"))).alias("video_id"), F.min_by("alias", F.when(F.col("n") == 1, F.struct("field_pos", "alias_pos"))).alias("matched_by"), F.min("n").alias("least"))
    out = records.select("record_id").join(best, "record_id", "left")
    status = F.when(F.col("least").isNull(), "unmatched").when(F.col("least") > 1, "ambiguous").otherwise("matched")
    return out.select("record_id", status.alias("status"), F.when(F.col("least") == 1, F.col("video_id")).alias("video_id"), F.when(F.col("least") == 1, F.col("matched_by")).alias("matched_by"))


def video_aliases(manifest: DataFrame) -> DataFrame:
    """(alias, video_id) of each video's id and path."""
    return manifest.select("video_id", F.explode(F.array_distinct(F.concat(S.alias_variants(F.col("video_id").cast("string")), S.alias_variants(F.col("path"))))).alias("alias"))


def import_report(matched: DataFrame, examples: int = 5) -> DataFrame:
    """Counts of each status and the first examples of it."""
    w = Window.partitionBy("status").orderBy("record_id")
    r = matched.withColumn("__r", F.row_number().over(w))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__r") <= examples, F.col("record_id")))).alias("examples"))


def first_sources(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Metadata of several sources, the first one's row of a key kept."""
    from .state import insert_or_ignore

    return insert_or_ignore(tables, keys)


def repeated_records(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, with how many more there were."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({"__r": F.row_number().over(w), "n_duplicates": F.count("*").over(Window.partitionBy(*keys)) - 1}).where("__r = 1").drop("__r")


def technical_sentence(media: DataFrame) -> DataFrame:
    text = F.format_string("Video %s: %dx%d, %s, %d ms, %s", F.col("video_id").cast("string"), F.col("width_px"), F.col("height_px"), F.coalesce("codec", F.lit("unknown codec")), F.col("duration_ms"), F.when(F.col("has_audio"), "with audio").otherwise("without audio"))
    return media.select(F.concat(F.lit("technical:"), F.col("video_id").cast("string")).alias("metadata_id"), "video_id", text.alias("text"))


def metadata_anchor(media: DataFrame, ocr: DataFrame, spoken: DataFrame, frames: DataFrame) -> DataFrame:
    """A video's anchor frame: its first text frame, else the best frame of its speech (video_id, frame_id, rank), else the frame
    nearest to its middle."""
    a = ocr.groupBy("video_id").agg(F.min_by("frame_id", F.struct("timestamp_ms", "frame_id")).alias("a"))
    b = spoken.groupBy("video_id").agg(F.min_by("frame_id", F.struct("rank", "frame_id")).alias("b"))
    c = as_of(media.select(F.col("video_id").cast("string").alias("probe_id"), "video_id", F.floor(F.col("duration_ms") / 2).alias("t")), frames).select("video_id", F.col("nearest.frame_id").alias("c"))
    out = media.select("video_id").join(a, "video_id", "left").join(b, "video_id", "left").join(c, "video_id", "left")
    return out.select("video_id", F.coalesce("a", "b", "c").alias("frame_id"), F.when(F.col("a").isNotNull(), "ocr").when(F.col("b").isNotNull(), "asr").otherwise("middle").alias("anchor"))


# ---------------------------------------------------------------- packs and answers


def evidence_pack(candidates: DataFrame, frames: DataFrame, evidence: DataFrame, window: int = VQA_WINDOW) -> DataFrame:
    """candidates (candidate_id, video_id, timestamp_ms) with the frames and the evidence (kind, text, video_id, start_ms, end_ms)
    within window ms, in order of time."""
    width = max(BUCKET, window)
    c = candidates.select("candidate_id", "video_id", F.greatest(F.lit(0), F.col("timestamp_ms") - window).alias("__a"), (F.col("timestamp_ms") + window).alias("__b"))
    near = interval_join(c, frames.select("video_id", "frame_id", F.col("timestamp_ms").alias("__t")), ("__a", "__b"), ("__t", "__t"), width=width).groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__t", "frame_id"))), lambda x: x["frame_id"]).alias("frames"))
    said = interval_join(c, evidence.select("video_id", "kind", "text", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e")), ("__a", "__b"), ("__s", "__e"), width=width)
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("__s", "text")))), lambda x: x["text"]).alias(kind)
    return candidates.join(near, "candidate_id", "left").join(said.groupBy("candidate_id").agg(texts("ocr"), texts("asr"), texts("object")), "candidate_id", "left")


def answer(pack: DataFrame) -> DataFrame:
    """The first text that isn't blank of a pack's OCR, then ASR; verified where there is one, else for manual review."""
    some = lambda c: F.get(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(t) != ""), F.lit(0))
    out = pack.withColumn("answer", T.normalize_answer(F.coalesce(some(F.col("ocr")), some(F.col("asr")), F.lit(""))))
    return out.withColumns({"verified": F.col("answer") != "", "manual": F.col("answer") == ""})


def media_path(candidates: DataFrame, media: DataFrame) -> DataFrame:
    """A candidate's media path, or a name made of its video's id."""
    return candidates.join(media.select("video_id", "original_video_path"), "video_id", "left").withColumn("media_path", F.coalesce("original_video_path", F.concat(F.col("video_id").cast("string"), F.lit(".mp4")))).drop("original_video_path")


def vector_references(frames: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """The vec_id of each model for frames; one that a model lacks is an error."""
    out = frames.select("video_id", "frame_id")
    for name, table in models.items():
        out = out.join(table.select("video_id", "frame_id", F.col("vec_id").alias(name)), ["video_id", "frame_id"], "left").withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"{name} lacks a frame")).cast("long")))
    return out


def resolve(references: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """references (ref) with the kind of the table whose id it is; null where none has it."""
    ids = reduce(DataFrame.unionByName, (t.select(F.col(key).cast("string").alias("ref"), F.lit(kind).alias("kind")) for kind, (t, key) in tables.items()))
    return references.join(ids.groupBy("ref").agg(F.min("kind").alias("kind"), F.count("*").alias("n")), "ref", "left")
