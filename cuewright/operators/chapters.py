"""Chapter lists: normalise, read from descriptions, choose a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import squeeze
from cuewright.plans.blocked import block_of, many_blocks, running
from cuewright.session import written_once

STAMPED_LINE = r"^\s*((?:\d{1,2}:)?\d{1,2}:\d{2})(?:\s*[-–—|]\s*|\s{2,}|\s+)(.+?)\s*$"
_STAMP_AHEAD = r"^\s*(?:\d{1,2}:)?\d{1,2}:\d{2}[\s\-–—|]"


def _number(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number >= 0, number)


def normalize_chapters(raw: DataFrame) -> DataFrame:
    """Chapters from ``video_id, pos, start, end, title, duration``.

    Blank titles, starts that do not grow and starts past the end are dropped; a chapter ends where
    the next begins; a video keeps its chapters only if two survive and every end follows its start.
    """
    titled = raw.select(
        "video_id",
        "pos",
        _number(F.col("start")).alias("start"),
        _number(F.col("end")).alias("given_end"),
        squeeze(F.coalesce("title", F.lit(""))).alias("title"),
        _number(F.col("duration")).alias("duration"),
    )
    eligible = titled.where(
        (F.col("title") != "")
        & F.col("start").isNotNull()
        & (F.col("duration").isNull() | (F.col("start") < F.col("duration")))
    ).withColumn("_blk", block_of("pos"))
    many = many_blocks(raw, "pos")
    # The last accepted start is the largest start seen so far among eligible rows.
    seen = running(eligible, ["video_id"], ["pos"], {"_max": ("max", F.col("start"))}, inclusive=False, many=many)
    accepted = seen.where(F.coalesce(F.col("start") > F.col("_max"), F.lit(True))).drop("_max")
    numbered = running(accepted, ["video_id"], ["pos"], {"idx": ("sum", F.lit(1).cast("long"))}, many=many)
    ahead = running(
        numbered, ["video_id"], ["pos"], {"_next": ("last", F.col("start"))}, inclusive=False, reverse=True, many=many
    )
    last_end = F.when(F.col("duration") > F.col("start"), F.col("duration")).otherwise(F.col("given_end"))
    ended = ahead.withColumn("end", F.coalesce("_next", last_end))
    verdict = (
        ended.groupBy("video_id")
        .agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("end") > F.col("start"), F.lit(False))).alias("fine"))
        .where((F.col("n") >= 2) & F.col("fine"))
    )
    return ended.join(verdict, "video_id", "left_semi").select(
        "video_id",
        F.col("idx").alias("index"),
        F.round("start", 3).alias("start"),
        F.round("end", 3).alias("end"),
        "title",
    )


def timestamp_seconds(stamp: Column) -> Column:
    """``[h:]mm:ss`` to seconds; null when minutes or seconds reach 60."""
    parts = F.split(stamp, ":")
    n = F.size(parts)
    seconds = F.element_at(parts, -1).cast("long")
    minutes = F.element_at(parts, -2).cast("long")
    hours = F.when(n == 3, F.element_at(parts, 1).cast("long")).otherwise(0)
    return F.when((seconds < 60) & (minutes < 60), (hours * 3600 + minutes * 60 + seconds).cast("double"))


def description_chapters(descriptions: DataFrame) -> DataFrame:
    """Chapters from the stamped lines of a description whose first stamp is 00:00.

    Lines become rows first, so that each is tested once, in compiled code, and a long description is no single value.
    """
    lines = descriptions.select("video_id", "duration", F.posexplode(F.split("description", r"\r\n|\n|\r")).alias("pos", "line"))
    # The whole pattern is matched once, on lines that begin as it does: stamp and title with a null character between.
    cut = lines.where(F.col("line").rlike(_STAMP_AHEAD)).withColumn("_cut", F.regexp_replace("line", STAMPED_LINE, "$1\u0000$2"))
    cut = cut.withColumn("_part", F.when(F.col("_cut") != F.col("line"), F.split("_cut", "\u0000", 2)))
    stamped = cut.select(
        "video_id",
        F.col("pos").cast("long").alias("pos"),
        timestamp_seconds(F.col("_part")[0]).alias("start"),
        F.lit(None).cast("double").alias("end"),
        squeeze(F.col("_part")[1]).alias("title"),
        "duration",
    )
    # The stamped lines are read several times and are far smaller than the descriptions.
    usable = written_once(stamped, "described").where("start is not null and title <> ''")
    begun = usable.groupBy("video_id").agg(F.min_by("start", "pos").alias("_first")).where("_first = 0")
    return normalize_chapters(usable.join(begun.select("video_id"), "video_id", "left_semi"))


def chapters(raw: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Structured chapters where a video has them, else those of its description, with the source."""
    structured = normalize_chapters(raw).withColumn("source", F.lit("yt-dlp"))
    described = description_chapters(descriptions).withColumn("source", F.lit("description"))
    missing = described.join(structured.select("video_id"), "video_id", "left_anti")
    return structured.unionByName(missing)
