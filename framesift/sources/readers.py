"""Readers of evidence tables.  A missing path is an empty table where the format is line JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalars as S


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders v=number under path whose write has ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
    return [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS")]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict: a row that doesn't parse is an error; blank lines are left out; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_faults(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line text) of rows that don't parse."""
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return rows.withColumn("r", parsed).where("r.__bad is not null").select("file", F.col("value").alias("line"))


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or line JSON by the path's suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if path.rstrip("/").endswith((".jsonl", ".json")) and schema:
        return json_lines(spark, path, schema)
    raise ValueError(f"neither parquet nor json lines: {path}")


def corpus(frames: DataFrame, videos: list[str] | None = None) -> DataFrame:
    """Frames of the chosen videos; a repeated (video, frame), more than one run or no row is an error."""
    f = frames.where(F.col("video_id").isin(videos)) if videos else frames
    runs = f.agg(F.countDistinct("preprocess_run_id").alias("n")).first()["n"]
    if runs != 1:
        raise ValueError(f"the corpus has {runs} runs")
    if not f.groupBy("video_id", "frame_id").count().where("count > 1").isEmpty():
        raise ValueError("a frame is there twice")
    return f.orderBy("video_id", "frame_id")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or TSV by suffix, with a header; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def json_payload(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of JSON files that hold a list, an object with items, videos, records or data, or one record."""
    texts = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    kind = T.ArrayType(record)
    inside = F.coalesce(*(F.from_json(F.get_json_object("v", f"$.{k}"), kind) for k in ("items", "videos", "records", "data")), F.array(F.from_json("v", record)))
    return texts.select(F.explode(F.when(F.col("v").startswith("["), F.from_json("v", kind)).otherwise(inside)).alias("r")).select("r.*")


def excel(spark: SparkSession, path: str, first: bool = False) -> DataFrame:
    """Rows of every sheet of a workbook, or of the first in the workbook's order (sheet, row, values): cells' strings, empty rows left out.

    The file is read by Spark; its parts are XML in a ZIP, which one function call a file parses.
    """
    schema = "sheet string, row int, values map<string,string>"

    def parse(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        def tag(e):
            return e.tag.rsplit("}", 1)[-1]

        def first_sheet(z, names, sheets):
            """The part that the workbook's first sheet refers to; without a workbook the first by name."""
            if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
                return sheets[:1]
            listed = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]
            wanted = next((v for e in listed[:1] for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
            targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            target = targets.get(wanted, "").lstrip("/").removeprefix("xl/")
            return [f"xl/{target}"] if f"xl/{target}" in names else sheets[:1]

        for pdf in batches:
            out = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    shared = []
                    if "xl/sharedStrings.xml" in names:
                        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
                    sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
                    if first:
                        sheets = first_sheet(z, names, sheets)
                    for name in sheets:
                        header: dict[str, str] = {}
                        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if tag(e) == "row"):
                            cells = {}
                            for c in (e for e in row if tag(e) == "c"):
                                text = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
                                cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = shared[int(text)] if c.get("t") == "s" and text else text
                            cells = {k: v for k, v in cells.items() if v.strip()}
                            if not cells:
                                continue
                            if not header:
                                header = {k: v.strip() for k, v in cells.items()}
                            else:
                                out.append((name.rsplit("/", 1)[-1].removesuffix(".xml"), int(row.get("r", 0)), {header.get(k, k): v for k, v in cells.items()}))
            yield pd.DataFrame(out, columns=["sheet", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def embedding_shards(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Vectors of a sharded store; of given ids only the shards whose ranges hold them are read."""
    shards = spark.read.parquet(f"{path}/shards")
    if ids is None:
        return shards.drop("shard")
    ranges = spark.read.parquet(f"{path}/manifest").select("shard", "record_start", "record_end")
    wanted = [r["shard"] for r in ranges.where(F.exists(F.array(*(F.lit(i) for i in ids)), lambda i: i.between(F.col("record_start"), F.col("record_end")))).collect()]  # ids at most
    return shards.where(F.col("shard").isin(wanted) & F.col("vec_id").isin(ids)).drop("shard")


def inspect_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose rows differ from the manifest, with the reason."""
    from .writers import manifest

    found = manifest(spark.read.parquet(f"{path}/shards")).select("shard", F.struct("record_start", "record_end", "n", "digest").alias("found"))
    said = spark.read.parquet(f"{path}/manifest").select("shard", F.struct("record_start", "record_end", "n", "digest").alias("said"))
    both = found.join(said, "shard", "full")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "not in the manifest").when(F.col("found.n") != F.col("said.n"), "number of rows").when(F.col("found") != F.col("said"), "content")
    return both.select("shard", reason.alias("fault")).where("fault is not null")


#: Limits of an archive that is unpacked: members, bytes of one, bytes of all, and bytes for each packed byte.
ZIP_LIMITS = (100_000, 20 << 30, 200 << 30, 200)


def safe_members(names_and_sizes: list[tuple[str, int, int, bool]], limits: tuple[int, int, int, int] = ZIP_LIMITS) -> None:
    """Raises unless an archive's members (name, size, packed size, whether a link) keep to the limits and stay in their folder."""
    members, one, every, ratio = limits
    if len(names_and_sizes) > members or sum(size for _, size, _, _ in names_and_sizes) > every:
        raise ValueError("the archive is too large")
    for name, size, packed, link in names_and_sizes:
        parts = name.replace("\\", "/").split("/")
        if link or ".." in parts or name.startswith(("/", "\\")) or ":" in parts[0]:
            raise ValueError(f"{name} leads out of the folder")
        if size > one or size > ratio * max(packed, 1):
            raise ValueError(f"{name} is too large")


def unzip(archive: str, folder: str, limits: tuple[int, int, int, int] = ZIP_LIMITS) -> list[str]:
    """Unpacks an archive on the driver, once all of its members are found safe."""
    import stat
    import zipfile

    with zipfile.ZipFile(archive) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        safe_members([(i.filename, i.file_size, i.compress_size, stat.S_ISLNK(i.external_attr >> 16)) for i in infos], limits)
        z.extractall(folder, [i.filename for i in infos])
        return [i.filename for i in infos]


def manifest_entries(rows: DataFrame) -> DataFrame:
    """(filename, link) of a batch manifest whose header names are near enough."""
    norm = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in rows.columns}
    pick = lambda *parts: S.first_of(rows.columns, [c for c in rows.columns if any(p in norm[c] for p in parts)])
    return rows.select(pick("filename", "file", "name").alias("filename"), pick("link", "url", "href").alias("link")).where("filename is not null and link is not null")


VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm")


def discover(spark: SparkSession, folder: str, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """Files of a folder, at any depth, by suffix: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)


def ingest(files: DataFrame) -> DataFrame:
    """files (video_id, path, sha256, length) with ingest_status: the first path of a content is accepted, others are
    duplicates of it; a repeated video_id is rejected."""
    by_content, by_id = Window.partitionBy("sha256").orderBy("path"), Window.partitionBy("video_id").orderBy("path")
    out = files.withColumns({"__first": F.first_value("video_id").over(by_content), "__n": F.row_number().over(by_content), "__i": F.row_number().over(by_id)})
    status = F.when(F.col("__n") > 1, "duplicate").when(F.col("__i") > 1, "rejected").otherwise("accepted")
    return out.withColumns({"ingest_status": status, "duplicate_of_video_id": F.when(F.col("__n") > 1, F.col("__first"))}).drop("__first", "__n", "__i")


def probe(rows: DataFrame) -> DataFrame:
    """Media columns of probe JSON (video_id, probe): stream rates, size, duration; variable where rates differ by over 0.01."""
    p = lambda k: F.get_json_object("probe", f"$.{k}")
    nominal, average = S.fraction(p("streams[0].r_frame_rate")), S.fraction(p("streams[0].avg_frame_rate"))
    out = rows.select("video_id", nominal.alias("fps_nominal"), average.alias("fps_average"), p("streams[0].width").cast("long").alias("width_px"), p("streams[0].height").cast("long").alias("height_px"), p("streams[0].codec_name").alias("codec"), F.round(p("format.duration").cast("double") * 1000).cast("long").alias("duration_ms"), p("streams[0].time_base").alias("time_base"))
    return out.withColumn("is_variable_frame_rate", F.abs(F.col("fps_nominal") - F.col("fps_average")) > 0.01)


def decoded_frames(rows: DataFrame) -> DataFrame:
    """Frame times of probe rows: the first of best-effort, presentation and decode times that is one."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit("N/A"))
    t = F.coalesce(*(some(c) for c in ("best_effort_timestamp_time", "pts_time", "pkt_dts_time")))
    return rows.withColumn("raw_timestamp_ms", F.bround(t.cast("decimal(20,6)") * 1000).cast("long"))


def all_shards(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """Every video's shard of a modality as one table."""
    return spark.read.parquet(f"{root}/modality={modality}")


def page(rows: DataFrame, key: str, cursor: int | None, size: int, most: int = 500) -> tuple[DataFrame, int | None]:
    """A page after the cursor, and the next cursor if there are more rows."""
    if not 1 <= size <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    got = (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(size + 1)
    keys = [r[0] for r in got.select(key).collect()]
    return got.where(F.col(key) <= keys[size - 1]) if len(keys) > size else got, keys[size - 1] if len(keys) > size else None


def cursor(x: str | None) -> int | None:
    if x is None or x == "":
        return None
    if not x.isdigit():
        raise ValueError("a cursor is a non-negative integer")
    return int(x)


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value given that isn't None."""
    conditions = [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def merged_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of parallel runs as one, the first row of a key kept."""
    from ..operators.state import insert_or_ignore

    return insert_or_ignore(runs, keys)
