"""Writers of evidence tables and submissions.  Spark's committer makes each write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parquet(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def shards(df: DataFrame, root: str, modality: str) -> None:
    """A modality's rows by video; open fields as JSON.  Only the written videos' partitions are replaced."""
    out = df.withColumn("fields_json", F.to_json("fields")).drop("fields") if "fields" in df.columns else df
    out.repartition("video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{root}/modality={modality}")


def promote(df: DataFrame, issues: list[DataFrame], path: str) -> None:
    """Writes one canonical table, if no P0 issue stands against it."""
    if not quality.report(issues).first()["gate"]:
        raise ValueError("the table has P0 issues")
    df.write.mode("overwrite").parquet(path)


def embedding_map(df: DataFrame, path: str) -> None:
    """The map of vectors: every column there and not null."""
    from .schemas import schema

    wanted = schema("embedding_map")
    missing = df.where(" or ".join(f"`{f.name}` is null" for f in wanted.fields))
    if not missing.isEmpty():
        raise ValueError("the embedding map has nulls")
    df.select(*(F.col(f.name).cast(f.dataType) for f in wanted.fields)).write.mode("overwrite").parquet(path)


#: The order in which each table's rows are written.
ORDERS = {
    "objects": ("video_id", "timestamp_ms", "frame_id", "detection_id"),
    "ocr": ("video_id", "timestamp_ms", "frame_id", "ocr_id"),
    "asr": ("video_id", "start_ms", "end_ms", "segment_id"),
    "metadata": ("video_id", "source", "metadata_id"),
    "frames": ("video_id", "timestamp_ms", "frame_id"),
}


def canonical(df: DataFrame, kind: str) -> DataFrame:
    """A table's rows in their order, over all of its files."""
    return df.orderBy(*(c for c in ORDERS[kind] if c in df.columns))


def embedding_shards(df: DataFrame, path: str, rows_per_shard: int) -> DataFrame:
    """Vectors (vec_id, embedding) in shards of ranges of ids, and their manifest: shard, record_start, record_end, n, digest."""
    shard = F.floor(F.col("vec_id") / rows_per_shard).cast("long")
    df.withColumn("shard", shard).repartition("shard").sortWithinPartitions("vec_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")
    manifest(df.sparkSession.read.parquet(f"{path}/shards")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def manifest(shards: DataFrame) -> DataFrame:
    """shard, record_start, record_end, n and a digest that doesn't depend on the rows' order."""
    row = F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")
    return shards.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.min("vec_id").alias("record_start"), F.max("vec_id").alias("record_end"), F.count("*").alias("n"), F.sum(row).cast("string").alias("digest"))


def commit(df: DataFrame, path: str, status: DataFrame, status_path: str) -> None:
    """The data, then the status row that says it is there: a crash in between leaves data that no status names."""
    df.write.mode("overwrite").parquet(path)
    status.write.mode("append").parquet(status_path)


def evidence_catalog(tables: dict[str, DataFrame], root: str) -> None:
    """The evidence tables, and the alias table of objects."""
    from ..operators.objects import alias_table

    for name, df in tables.items():
        parquet(df, f"{root}/{name}")
    if "objects" in tables:
        parquet(alias_table(tables["objects"]), f"{root}/object_aliases")


def kis_rows(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "frame_id")


def qa_rows(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "frame_id", "answer")


def trake_rows(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.select("query_id", F.to_json(F.struct("video_id", "frames", "aggregate_score")).alias("trake"))


def submission(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
