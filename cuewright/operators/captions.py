"""Caption events to cues, to interpolated word timings, to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions.text import squeeze, strip
from cuewright.operators import sentences as snt
from cuewright.plans.blocked import block_of, dense_position, many_blocks

# Cues per block; a cue holds one display line.
CUE_BLOCK = 4096


def cues(events: DataFrame) -> DataFrame:
    """Caption events with pieces of text, joined and stripped; milliseconds to seconds."""
    text = strip(F.array_join(F.transform("segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return (
        events.where(F.size("segs") > 0)
        .select(
            "video_id",
            "event_idx",
            text.alias("text"),
            (F.coalesce("tStartMs", F.lit(0)) / 1000.0).alias("start"),
            (F.coalesce("dDurationMs", F.lit(0)) / 1000.0).alias("duration"),
        )
        .where(F.col("text") != "")
    )


def pseudo_words(cue_rows: DataFrame, many: bool | None = None) -> DataFrame:
    """Spread each cue's words over its time by length; dense ``word_idx`` per video.

    Windows run inside one cue. Times are rounded to milliseconds, words of a cue are contiguous and
    the last one is clamped to the end of the cue.
    """
    tokens = cue_rows.select(
        "video_id",
        "event_idx",
        F.col("start").alias("cue_start"),
        F.greatest("duration", F.lit(fv.MIN_CUE_SECONDS)).alias("cue_dur"),
        F.posexplode_outer(F.split(squeeze(F.col("text")), " ")).alias("pos", "word"),
    ).where(F.col("word") != "")
    cue = Window.partitionBy("video_id", "event_idx")
    upto = cue.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("word") + 1
    placed = tokens.withColumns(
        {"_cum": F.sum(size).over(upto), "_size": size, "_total": F.greatest(F.sum(size).over(cue) - 1, F.lit(1))}
    )

    def at(chars):
        return F.round(F.col("cue_start") + F.col("cue_dur") * F.least(F.lit(1.0), chars / F.col("_total")), 3)

    timed = placed.select(
        "video_id",
        "event_idx",
        "pos",
        "word",
        at(F.col("_cum") - F.col("_size")).alias("start"),
        at(F.col("_cum")).alias("end"),
    )
    if many is None:
        many = many_blocks(cue_rows, "event_idx", CUE_BLOCK)
    return dense_position(
        timed, ["video_id"], ["event_idx", "pos"], block_of("event_idx", CUE_BLOCK), "word_idx", many
    )


def caption_reflow(
    events: DataFrame,
    alpha: float = fv.CAPTION_PAUSE_ALPHA,
    max_words: int = fv.SENTENCE_MAX_WORDS,
    min_words: int = fv.SENTENCE_MIN_WORDS,
    many_cues: bool | None = None,
) -> DataFrame:
    """Captions, cut by display line, rebuilt into sentences.

    Whether a video's words leave a first block is counted on the cues, before they are words.
    """
    found = cues(events)
    spread = found.groupBy("video_id").agg(F.sum(F.size(F.split(squeeze(F.col("text")), " "))).alias("n"))
    many = many_blocks(spread, F.col("n") - 1)
    return snt.sentences(pseudo_words(found, many_cues), ("video_id",), alpha, max_words, min_words, many)
