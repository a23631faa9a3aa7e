"""Segment timing: source, speech and playback ranges on one time line per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.plans.blocked import block_window, drop_halo, many_blocks, with_halo

FLAT_PAIRS = {
    "playback_tts": ("tts_playback_start", "tts_playback_end"),
    "tts": ("tts_start", "tts_end"),
    "playback": ("playback_start", "playback_end"),
}


def _pair(start: Column, end: Column) -> Column:
    """``struct<start, end>`` only when both ends are known."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def source_range(segments: DataFrame) -> DataFrame:
    """Add ``src_start`` / ``src_end``: a line lasts until the next line starts."""
    many = many_blocks(segments, "seg_idx")
    ahead = with_halo(segments, "seg_idx", after=1, many=many)
    following = F.lead("start").over(block_window(["video_id"], "seg_idx", many=many))
    end = F.coalesce(F.col("_next"), F.col("start") + F.col("duration"))
    return (
        drop_halo(ahead.withColumn("_next", following))
        .withColumns({"src_start": F.col("start"), "src_end": end})
        .withColumn("src_end", repaired_end(F.col("src_start"), F.col("src_end"), F.col("duration")))
        .drop("_next", "_blk")
    )


def repaired_end(start: Column, end: Column, duration: Column, least: float = fv.MIN_RANGE_SECONDS) -> Column:
    return F.when(end <= start, start + F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(least))).otherwise(end)


def speech_pair(playback: bool) -> Column:
    """Speech range: on the output time line when asked and known, else on the source time line."""
    choices = [
        _pair(F.col("tts.start"), F.col("tts.end")),
        _pair(*(F.col(c) for c in FLAT_PAIRS["tts"])),
    ]
    if playback:
        choices = [
            _pair(F.col("playback.tts_start"), F.col("playback.tts_end")),
            _pair(*(F.col(c) for c in FLAT_PAIRS["playback_tts"])),
            *choices,
        ]
    return F.coalesce(*choices)


def playback_pair() -> Column:
    return F.coalesce(
        _pair(F.col("playback.start"), F.col("playback.end")),
        _pair(*(F.col(c) for c in FLAT_PAIRS["playback"])),
    )


def display_range(segments: DataFrame, prefer_speech: bool = False) -> DataFrame:
    """Add ``disp_start`` / ``disp_end``; needs the ``tts`` / ``playback`` structs and flat columns."""

    def valid(pair: Column) -> Column:
        return F.when(pair["end"] > pair["start"], pair)

    choices = [valid(playback_pair()), F.struct(F.col("src_start").alias("start"), F.col("src_end").alias("end"))]
    if prefer_speech:
        choices.insert(0, valid(speech_pair(playback=True)))
    ranged = source_range(segments).withColumn("_disp", F.coalesce(*choices))
    return ranged.withColumns({"disp_start": F.col("_disp.start"), "disp_end": F.col("_disp.end")}).drop("_disp")


def clear_timing(segments: DataFrame) -> DataFrame:
    """Drop all generated timing before a fresh run."""
    return segments.drop("tts", "playback", *fv.LEGACY_TIMING_KEYS)


def migrate_timing(segments: DataFrame) -> DataFrame:
    """Fold flat legacy timing into the nested structs and drop the flat columns."""
    nested_tts = F.coalesce(
        _pair(F.col("tts.start"), F.col("tts.end")), _pair(*(F.col(c) for c in FLAT_PAIRS["tts"]))
    )
    own, spoken = playback_pair(), F.coalesce(
        _pair(F.col("playback.tts_start"), F.col("playback.tts_end")),
        _pair(*(F.col(c) for c in FLAT_PAIRS["playback_tts"])),
    )
    playback = F.struct(
        own["start"].alias("start"),
        own["end"].alias("end"),
        spoken["start"].alias("tts_start"),
        spoken["end"].alias("tts_end"),
    )
    folded = segments.withColumns(
        {"_tts": nested_tts, "_playback": F.when(own.isNotNull() | spoken.isNotNull(), playback)}
    )
    return clear_timing(folded).withColumnsRenamed({"_tts": "tts", "_playback": "playback"})


def playback_timing(segments: DataFrame, speed: float | Column) -> DataFrame:
    """Times on the output video played ``speed`` times faster, rounded to milliseconds."""
    speed = F.lit(float(speed or 1.0)) if isinstance(speed, (int, float)) else speed
    start, end = F.col("src_start"), F.col("src_end")
    said = F.col("tts.start").isNotNull() & F.col("tts.end").isNotNull()
    tts_start = F.col("tts.start")
    tts_end = repaired_end(tts_start, F.col("tts.end"), F.col("tts.duration"), fv.MIN_SPEECH_SECONDS)
    playback = F.struct(
        speed.alias("speed"),
        F.round(start / speed, 3).alias("start"),
        F.round(end / speed, 3).alias("end"),
        F.round((end - start) / speed, 3).alias("duration"),
        F.when(said, F.round(tts_start / speed, 3)).alias("tts_start"),
        F.when(said, F.round(tts_end / speed, 3)).alias("tts_end"),
        F.when(said, F.round((tts_end - tts_start) / speed, 3)).alias("tts_duration"),
    )
    stale = [k for k in fv.LEGACY_TIMING_KEYS if not k.startswith("tts_") or "playback" in k]
    return source_range(segments).withColumn("playback", playback).drop(*stale, "src_start", "src_end")


def merge_warnings(existing: Column, new: Column) -> Column:
    """Append new warnings, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(existing, none), F.coalesce(new, none)))


def allocate_timing(segments: DataFrame, events: DataFrame, engine: str = "supertonic") -> DataFrame:
    """Share each synthesised event among its source lines by text length; the last event wins.

    ``events``: ``video_id, event_idx, source_indices, start, speech_duration``. Joins are on
    ``(video_id, seg_idx)``; windows run inside one event, whose index list is a single value.
    """
    text = F.coalesce(F.nullif(F.col("text_vi"), F.lit("")), F.nullif(F.col("text_tts"), F.lit("")), F.col("text"))
    slots = source_range(segments).select(
        "video_id",
        "seg_idx",
        "src_start",
        "src_end",
        F.greatest(F.lit(1), F.length(F.coalesce(text, F.lit("")))).alias("weight"),
    )
    members = events.select(
        "video_id",
        "event_idx",
        F.col("start").alias("event_start"),
        F.greatest(F.lit(0.0), F.coalesce("speech_duration", F.lit(0.0))).alias("speech"),
        F.posexplode("source_indices").alias("ord", "seg_idx"),
    ).withColumn("seg_idx", F.col("seg_idx").cast("long"))
    event = Window.partitionBy("video_id", "event_idx")
    before = event.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    target = F.greatest(F.lit(0.0), F.col("src_end") - F.col("src_start"))
    silent_step = F.greatest(target, F.lit(fv.MIN_SPEECH_SECONDS))
    rows = members.join(slots, ["video_id", "seg_idx"]).withColumns(
        {
            "target": target,
            "total": F.sum("weight").over(event),
            "members": F.count("*").over(event),
            "done": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "silent_done": F.coalesce(F.sum(silent_step).over(before), F.lit(0.0)),
            "place": F.row_number().over(event.orderBy("ord")),
            "first_src": F.first("src_start").over(event.orderBy("ord")),
        }
    )
    begin = F.coalesce("event_start", "first_src")
    speech, floor_s = F.col("speech"), F.lit(fv.MIN_SPEECH_SECONDS)
    if engine == "supertonic":
        t = F.greatest(F.col("src_start"), F.least(begin, F.col("src_end")))
        own = (
            F.when(F.col("members") == 1, speech)
            .when(speech > 0, speech * F.col("weight") / F.col("total"))
            .otherwise(F.col("target"))
        )
        end = F.least(F.col("src_end"), t + F.greatest(own, floor_s))
    else:
        t = F.when(speech > 0, begin + speech * F.col("done") / F.col("total")).otherwise(begin + F.col("silent_done"))
        end = (
            F.when(speech <= 0, t)
            .when(F.col("place") == F.col("members"), begin + speech)
            .otherwise(begin + speech * (F.col("done") + F.col("weight")) / F.col("total"))
        )
    timed = rows.withColumns({"t": t, "e": end}).withColumn(
        "e", F.when(F.col("e") <= F.col("t"), F.col("t") + F.greatest(F.col("target"), floor_s)).otherwise(F.col("e"))
    )
    block = F.struct(
        F.lit(engine).alias("engine"),
        F.round("t", 3).alias("start"),
        F.round("e", 3).alias("end"),
        F.round(F.col("e") - F.col("t"), 3).alias("duration"),
        F.round("src_start", 3).alias("slot_start"),
        F.round("src_end", 3).alias("slot_end"),
        F.round("target", 3).alias("target_duration"),
    )
    newest = F.struct("event_idx", "ord")
    return timed.groupBy("video_id", "seg_idx").agg(
        F.max("event_idx").alias("event_idx"), F.max_by(block, newest).alias("tts")
    )


def attach_timings(segments: DataFrame, events: DataFrame, engine: str = "supertonic") -> DataFrame:
    """Segments with their new ``tts`` block; warnings of the event's fit report are appended once.

    ``events`` additionally carries ``fit_warnings array<string>``; ``segments`` carries ``warnings``.
    """
    clean = segments.drop("tts", *FLAT_PAIRS["tts"], "tts_duration")
    allocated = allocate_timing(clean, events, engine)
    said = events.select(
        "video_id", "event_idx", "fit_warnings", F.explode(F.array_distinct("source_indices")).alias("seg_idx")
    ).where(F.size("fit_warnings") > 0)
    # An overwritten event still leaves its warnings on the line, in event order.
    notes = (
        said.withColumn("seg_idx", F.col("seg_idx").cast("long"))
        .select("video_id", "seg_idx", "event_idx", F.posexplode("fit_warnings").alias("at", "warning"))
        .groupBy("video_id", "seg_idx", "warning")
        .agg(F.min(F.struct("event_idx", "at")).alias("first_seen"))
        .groupBy("video_id", "seg_idx")
        .agg(F.sort_array(F.collect_list(F.struct("first_seen", "warning"))).alias("n"))
        .select("video_id", "seg_idx", F.transform("n", lambda x: x["warning"]).alias("_new"))
    )
    return (
        clean.join(allocated, ["video_id", "seg_idx"], "left")
        .join(notes, ["video_id", "seg_idx"], "left")
        .withColumn("warnings", merge_warnings(F.col("warnings"), F.col("_new")))
        .drop("_new")
    )
