"""Schemas and constraints of the evidence tables.  Tables are always read with a schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AUDIT = "schema_version string, created_at_utc string"
_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"

SCHEMAS: dict[str, str] = {
    "corpus_manifest": f"video_id string, source_archive string, original_video_path string, source_sha256 string, file_size_bytes long, batch_id string, duplicate_of_video_id string, ingest_status string, {_AUDIT}",
    "media": f"preprocess_run_id string, video_id string, original_video_path string, source_sha256 string, time_base string, fps_nominal double, fps_average double, is_variable_frame_rate boolean, frame_count long, duration_ms long, width_px long, height_px long, codec string, has_audio boolean, {_AUDIT}",
    "frame_index": f"preprocess_run_id string, video_id string, frame_id long, decode_index long, pts long, dts long, time_base string, raw_timestamp_ms long, timeline_origin_ms long, timestamp_ms long, is_technical_keyframe boolean, {_AUDIT}",
    "frames": f"preprocess_run_id string, video_id string, frame_id long, keyframe_seq long, timestamp_ms long, pts long, time_base string, decode_index long, shot_id string, keyframe_path string, thumbnail_path string, selection_reason string, quality double, {_AUDIT}",
    "shots": f"preprocess_run_id string, video_id string, shot_id string, start_frame_id long, end_frame_id long, start_timestamp_ms long, end_timestamp_ms long, start_pts long, end_pts long, detector_name string, detector_version string, confidence double, {_AUDIT}",
    "ocr": f"preprocess_run_id string, detection_id string, video_id string, frame_id long, timestamp_ms long, raw_text string, normalized_text string, normalized_text_no_diacritics string, punctuation_aware_text string, character_ngrams array<string>, bbox_xyxy_norm {_BOX}, confidence double, below_threshold boolean, model_name string, model_version string, {_AUDIT}",
    "asr": f"preprocess_run_id string, segment_id string, video_id string, start_ms long, end_ms long, text string, normalized_text string, normalized_text_no_diacritics string, language string, confidence double, avg_logprob double, words array<struct<start_ms:long,end_ms:long,word:string,probability:double>>, vad_segment_id string, {_AUDIT}",
    "objects": f"preprocess_run_id string, detection_id string, video_id string, frame_id long, timestamp_ms long, label string, canonical_label string, label_aliases array<string>, class_id long, bbox_xyxy_norm {_BOX}, center_xy_norm struct<x:double,y:double>, spatial_region string, area_ratio double, count_in_frame long, raw_count_in_frame long, confidence double, below_threshold boolean, {_AUDIT}",
    "metadata": f"preprocess_run_id string, metadata_id string, video_id string, source string, title string, description string, tags array<string>, channel string, upload_date string, language string, youtube_video_id string, window_start_ms long, window_end_ms long, text string, normalized_text string, normalized_text_no_diacritics string, source_record_sha256 string, matched_by string, raw_fields string, {_AUDIT}",
    "embedding_map": "schema_version string, preprocess_run_id string, model_name string, model_version string, vector_id long, video_id string, frame_id long, keyframe_seq int, timestamp_ms long, embedding_dim int, vector_dtype string, l2_normalized boolean, keyframe_path string, created_at_utc string",
    "text_documents": "doc_id string, source string, text string, fields map<string,string>, metadata string",
    "search_candidate": "query_id string, event_index long, video_id string, frame_id long, representative_frame_id long, timestamp_ms long, window_start_ms long, window_end_ms long, source string, raw_score double, score double, rank long, model_scores map<string,double>, model_ranks map<string,long>, matched_filters array<string>, evidence_refs array<string>, provenance_sources array<string>, provenance string, confidence double, preprocess_run_id string",
    "labelled_queries": "query_id string, query_text string, query_type string, language string, relevant_video_ids array<string>, relevant_frame_intervals array<struct<video_id:string,start_ms:long,end_ms:long>>",
    "sessions": "session_id string, artifact_run_id string, created_at string, expires_at string, revision long, state string",
    "module_status": f"run_id string, video_id string, module string, status string, fingerprint string, checksum_ok boolean, details string, {_AUDIT}",
}

# Names that a column may hold.
VALUES = {
    ("corpus_manifest", "ingest_status"): ("accepted", "duplicate", "rejected"),
    ("metadata", "source"): ("technical", "organizer_youtube", "automatic_video_text", "user_annotation"),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def exported() -> dict[str, str]:
    """JSON of every schema."""
    return {name: schema(name).json() for name in SCHEMAS}


def constraints(name: str) -> dict[str, Column]:
    """Conditions that each row of a table must meet."""
    out: dict[str, Column] = {}
    for f in schema(name).fields:
        c = F.col(f.name)
        if f.name.endswith(("_ms", "frame_id", "_px", "decode_index")) and f.dataType == T.LongType() or f.name in ("frame_count", "file_size_bytes", "vector_id"):
            out[f"{f.name} is not negative"] = F.coalesce(c >= 0, F.lit(True))
        if f.name == "confidence":
            out["confidence is in [0, 1]"] = F.coalesce(c.between(0, 1), F.lit(True))
        if f.name.endswith("sha256"):
            out[f"{f.name} is a digest"] = F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(True))
        if (name, f.name) in VALUES:
            out[f"{f.name} is known"] = c.isin(*VALUES[name, f.name])
    if {"start_ms", "end_ms"} <= {f.name for f in schema(name).fields}:
        out["interval is closed"] = F.col("end_ms") >= F.col("start_ms")
    return out
