"""Object evidence: counts, truncation, query parsing and frame scores."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

# Defaults, and the words of object queries.
THRESHOLD, MOST_PER_FRAME = 0.25, 300
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}
RELATIONS = {"left of": "left_of", "right of": "right_of", "above": "above", "below": "below", "bên trái": "left_of", "bên phải": "right_of", "phía trên": "above", "phía dưới": "below"}


# What names a region, in the order in which they are looked for.
REGION_TERMS = {
    "left": ("left", "bên trái", "trái"),
    "right": ("right", "bên phải", "phải"),
    "top": ("top", "phía trên", "trên"),
    "bottom": ("bottom", "phía dưới", "dưới"),
    "center": ("center", "centre", "middle", "ở giữa", "trung tâm"),
}


def truncate(detections: DataFrame, most: int = MOST_PER_FRAME) -> DataFrame:
    """The most confident detections of a frame, unknown confidence last, in the detector's order on ties."""
    w = Window.partitionBy("video_id", "frame_id").orderBy(F.col("confidence").desc_nulls_last(), "position")
    return detections.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def flag(detections: DataFrame, threshold: float = THRESHOLD, allowed: list[str] | None = None, keep_low: bool = True) -> DataFrame:
    """below_threshold; rows outside the allowed labels, and low ones unless kept, go."""
    out = detections.withColumn("below_threshold", F.coalesce("confidence", F.lit(0.0)) < threshold)
    if allowed is not None:
        out = out.where(F.col("canonical_label").isin(allowed))
    return out if keep_low else out.where("not below_threshold")


def count_in_frame(detections: DataFrame) -> DataFrame:
    """count_in_frame (rows not below the threshold) and raw_count_in_frame of each row's label."""
    w = Window.partitionBy("video_id", "frame_id", "canonical_label")
    return detections.withColumns({"count_in_frame": F.count_if(~F.col("below_threshold")).over(w), "raw_count_in_frame": F.count(F.lit(1)).over(w)})


def representatives(detections: DataFrame) -> DataFrame:
    """One row for each canonical label: the first by row_id."""
    return detections.groupBy("canonical_label").agg(F.min("row_id").alias("row_id"), F.min_by("detection_id", "row_id").alias("detection_id"), F.count("*").alias("n"))


def alias_table(detections: DataFrame) -> DataFrame:
    return detections.select("detection_id", F.explode(F.array_distinct(F.concat(F.array("label", "canonical_label"), F.coalesce("label_aliases", F.array().cast("array<string>"))))).alias("alias")).select("detection_id", S.label(F.col("alias")).alias("alias")).distinct()


def filter_objects(detections: DataFrame, aliases: DataFrame, labels: list[str] | None = None, least: float = 0.0, video_id: str | None = None) -> DataFrame:
    """Rows at or above a confidence, not below the threshold, with one of the labels among their aliases."""
    out = detections.where((F.coalesce("confidence", F.lit(0.0)) >= least) & ~F.col("below_threshold"))
    if video_id is not None:
        out = out.where(F.col("video_id") == video_id)
    if labels:
        out = out.join(aliases.where(F.col("alias").isin([x.lower() for x in labels])), "detection_id", "left_semi")
    return out


def related(detections: DataFrame, first: str, second: str, relation: str) -> DataFrame:
    """Frames where some detection of the first label stands in the relation to one of the second."""
    a = detections.where(F.col("canonical_label") == first).select("video_id", "frame_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = detections.where(F.col("canonical_label") == second).select("video_id", "frame_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    # the extremes of a label decide whether any pair stands in the relation
    a = a.groupBy("video_id", "frame_id").agg(F.min("ax").alias("ax0"), F.max("ax").alias("ax1"), F.min("ay").alias("ay0"), F.max("ay").alias("ay1"))
    b = b.groupBy("video_id", "frame_id").agg(F.min("bx").alias("bx0"), F.max("bx").alias("bx1"), F.min("by").alias("by0"), F.max("by").alias("by1"))
    holds = {"left_of": F.col("ax0") < F.col("bx1"), "right_of": F.col("ax1") > F.col("bx0"), "above": F.col("ay0") < F.col("by1"), "below": F.col("ay1") > F.col("by0")}[relation]
    return a.join(b, ["video_id", "frame_id"]).where(holds).select("video_id", "frame_id")


@dataclass
class ObjectQuery:
    labels: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    region: str | None = None
    relation: tuple[str, str, str] | None = None


def parse_query(text: str, aliases: dict[str, str]) -> ObjectQuery:
    """Labels in the order of their places, a count before a label (one or two digits, or a word), a region and a relation.

    The region is a side or the centre, whatever the row or column: left is top_left, middle_left and bottom_left.
    """
    low = re.sub(r"\s+", " ", text.lower().replace("_", " ")).strip()
    places = sorted((m.start(), -len(a), m.end(), c) for a, c in aliases.items() for m in re.finditer(rf"(?<!\w){re.escape(a)}s?(?!\w)", low))
    query, taken = ObjectQuery(), 0
    at: list[tuple[int, int, str]] = []
    for start, _, end, c in places:
        if start < taken:
            continue
        taken = end
        at.append((start, end, c))
        if c not in query.labels:
            query.labels.append(c)
        if m := re.search(r"(\w+)\s+$", low[:start]):
            n = int(m[1]) if re.fullmatch(r"\d{1,2}", m[1]) else NUMBER_WORDS.get(m[1])
            if n is not None:
                query.counts[c] = n
    if not query.counts and query.labels:  # a number elsewhere counts the first label
        words = [int(w) if re.fullmatch(r"\d{1,2}", w) else NUMBER_WORDS.get(w) for w in re.findall(r"\w+", low)]
        if (n := next((w for w in words if w is not None), None)) is not None:
            query.counts[query.labels[0]] = n
    query.region = next((name for name, terms in REGION_TERMS.items() if any(t in low for t in terms)), None)
    for words, name in RELATIONS.items():
        k = low.find(words)
        if k >= 0 and (left := [c for _, e, c in at if e <= k]) and (right := [c for s, _, c in at if s >= k + len(words)]):
            query.relation, query.region = (left[-1], name, right[0]), None  # its words name no region
            break
    return query


def frame_scores(detections: DataFrame, query: ObjectQuery, hard: bool = False) -> DataFrame:
    """(video_id, frame_id, score): 2 * matched / asked labels (or a quarter of the best confidence), +1.5 or -0.5 for counts, +1 or
    -0.25 for the region, +1.5 or -0.5 for the relation, + half of the best confidence; above 0 where labels are asked for."""
    rows = detections.where("not below_threshold")
    asked = F.col("canonical_label").isin(query.labels) if query.labels else F.lit(True)
    aggregates = [F.countDistinct(F.when(asked, F.col("canonical_label"))).alias("matched"), F.max(F.when(asked, F.coalesce("confidence", F.lit(0.0)))).alias("best")]
    aggregates += [F.count_if(F.col("canonical_label") == c).alias(f"n{i}") for i, c in enumerate(query.counts)]
    if query.region:
        first = F.col("canonical_label") == query.labels[0] if query.labels else F.lit(True)
        aggregates.append(F.coalesce(F.bool_or(first & F.col("spatial_region").contains(query.region)), F.lit(False)).alias("in_region"))
    out = rows.groupBy("video_id", "frame_id").agg(*aggregates)
    best = F.coalesce("best", F.lit(0.0))
    score = (2.0 * F.col("matched") / len(query.labels) if query.labels else 0.25 * best) + 0.5 * best
    ok = F.lit(True)
    for i, n in enumerate(query.counts.values()):
        score, ok = score + F.when(F.col(f"n{i}") == n, 1.5).otherwise(-0.5), ok & (F.col(f"n{i}") == n)
    if query.region:
        score, ok = score + F.when(F.col("in_region"), 1.0).otherwise(-0.25), ok & F.col("in_region")
    if query.relation:
        a, name, b = query.relation
        out = out.join(related(rows, a, b, name).withColumn("related", F.lit(True)), ["video_id", "frame_id"], "left")
        held = F.coalesce("related", F.lit(False))
        score, ok = score + F.when(held, 1.5).otherwise(-0.5), ok & held
    out = out.withColumn("score", score)
    if hard:
        out = out.where(ok & ((F.col("matched") == len(query.labels)) if query.labels else F.lit(True)))
    if query.labels:
        out = out.where((F.col("matched") > 0) & (F.col("score") > 0))
    return out.select("video_id", "frame_id", "score")


def search(detections: DataFrame, query: ObjectQuery, limit: int = 20, hard: bool = False) -> DataFrame:
    return frame_scores(detections, query, hard).orderBy(F.desc("score"), "video_id", "frame_id").limit(limit)


def candidate_boost(candidates: DataFrame, detections: DataFrame, labels: list[str]) -> DataFrame:
    """A quarter of the best confidence of a matching detection in the candidate's frame, at most 0.25."""
    best = detections.where(F.col("canonical_label").isin(labels)).groupBy("video_id", "frame_id").agg(F.max("confidence").alias("__c"))
    return candidates.join(best, ["video_id", "frame_id"], "left").withColumn("boost", F.least(F.lit(0.25), F.coalesce(F.col("__c"), F.lit(0.0)) * 0.25)).drop("__c")
