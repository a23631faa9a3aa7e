"""Readers for transcripts, metadata, run logs, glossaries, summaries and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright import schemas
from cuewright.functions.text import strip


def parse_segments(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments, corrupt)`` from ``video_id, first_idx, payload`` with a JSON array per row.

    Elements that are no objects are skipped but keep their index; a payload that is no array is
    corrupt. Work stays inside the row.
    """
    items = F.from_json("payload", "array<string>")
    good = strip(F.col("payload")).startswith("[") & items.isNotNull()
    elements = (
        payloads.where(good)
        .select("video_id", "first_idx", F.posexplode_outer(items).alias("at", "item"))
        .where(F.col("item").startswith("{"))
    )
    segments = elements.select(
        "video_id",
        (F.col("first_idx") + F.col("at")).alias("seg_idx"),
        F.from_json("item", schemas.SEGMENT).alias("s"),
    ).select("video_id", "seg_idx", "s.*")
    corrupt = payloads.where(~F.coalesce(good, F.lit(False))).select("video_id", "first_idx", F.lit("not_a_list").alias("error"))
    return segments, corrupt


def read_segment_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON array file per video, named ``<video_id>.json``."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return parse_segments(
        files.select(name.alias("video_id"), F.lit(0).cast("long").alias("first_idx"), F.col("value").alias("payload"))
    )


def read_segment_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines ``{"video_id", "first_idx", "segments": [...]}``; long videos span several lines."""
    lines = spark.read.schema("video_id string, first_idx long, segments string").json(path)
    return parse_segments(lines.withColumnRenamed("segments", "payload"))


def read_metadata(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.METADATA).option("multiLine", multi_line).json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run-log CSV as text columns; ``NaN`` and missing columns are null, the legacy column is folded."""
    raw = spark.read.csv(path, header=True, nullValue=fv.NAN, escape='"')
    have = set(raw.columns)
    asr = [F.col(c) for c in ("asr_time_sec", "whisper_time_sec") if c in have]
    return raw.select(
        *[
            (F.coalesce(*asr) if c == "asr_time_sec" and asr else F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
            for c in fv.RUN_LOG_COLUMNS
        ]
    )


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """User entries ``written, spoken`` of a JSON object file; a broken file yields no rows."""
    mapping = F.from_json("value", "map<string,string>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(mapping).alias("written", "spoken"))
        .where((strip(F.col("written")) != "") & (strip(F.col("spoken")) != ""))
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored summaries that have text, marked as cached."""
    rows = spark.read.schema(schemas.SUMMARY).json(path)
    return rows.where(F.col("summary") != "").withColumn("cached", F.lit(True))


def list_artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path`` with their modification time; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "modificationTime", "length")
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        name.alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.col("modificationTime").alias("mtime"),
        "length",
    )
