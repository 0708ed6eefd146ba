"""Query routing and event lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that add a branch.
OCR_WORDS = r"(?iu)\b(text|sign|caption|written|banner|logo|title|chữ|biển|dòng chữ|tiêu đề)\b"
ASR_WORDS = r"(?iu)\b(say|says|said|speak|speaks|voice|mentions|nói|phát biểu|lời)\b"
OBJECT_WORDS = r"(?iu)\b(person|people|car|dog|cat|man|woman|holding|wearing|người|xe|chó|mèo|cầm|mặc)\b"
INTRO = r"(?iu)(sequence|events?|order|chuỗi|sự kiện|thứ tự)[^:]*:"


def branches(query: Column, task: str = "KIS", hints: Column | None = None) -> Column:
    """Branches of a query: visual always; text, speech and objects by their words (in hints for questions); metadata for KIS."""
    words = F.concat_ws(" ", query, hints) if hints is not None else query
    add = lambda name, rule: F.when(words.rlike(rule), name)
    return F.array_distinct(F.array_compact(F.array(F.lit("visual"), add("ocr", OCR_WORDS), add("asr", ASR_WORDS), add("object", OBJECT_WORDS), F.lit("metadata" if task == "KIS" else None).cast("string"))))


def split_events(query: Column) -> Column:
    """Events of a list parted by (1), ; or line ends; an introduction that ends in a colon is dropped."""
    body = F.when(query.rlike(INTRO), F.regexp_replace(query, r"^[^:]*:", "")).otherwise(query)
    return F.filter(F.transform(F.split(body, r"\(\d+\)|;|\n"), lambda x: F.trim(x)), lambda x: x != "")
