"""Whole-transcript results and transcript statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions.text import fmt_time, strip
from cuewright.plans.blocked import block_of, running, with_offsets


def full_text(segments: DataFrame) -> DataFrame:
    """``video_id, seg_idx, offset, piece``: the transcript as pieces in order, and the character at which each starts.

    Joined by spaces, a video's pieces are its text (null lines are left out). A row per line at every length, so that no
    value grows with a video; ``sinks.write_files`` makes one file of them.
    """
    rows = segments.where("text is not null").select("video_id", "seg_idx", F.col("text").alias("piece"))
    return with_offsets(rows, ["video_id"], "seg_idx", F.char_length("piece") + 1)


def capped_transcript(segments: DataFrame, cap: int = fv.TRANSCRIPT_CAP_CHARS, order: str = "seg_idx") -> DataFrame:
    """Labelled lines up to ``cap`` characters, then one marker line (``start, end, text``).

    A line stays when all earlier lines and their line breaks leave room for it; the sum only grows,
    so no line after the first overflow can stay, and at most ``cap`` characters are gathered.
    """
    start = F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0)))
    end = F.greatest(start, F.coalesce("end", start))
    text = strip(F.coalesce("text", F.lit("")))
    lines = segments.where(text != "").select(
        "video_id", order, F.concat(F.lit("["), fmt_time(start), F.lit("-"), fmt_time(end), F.lit("] "), text).alias("line")
    )
    summed = running(
        lines.withColumn("_blk", block_of(order)),
        ["video_id"],
        [order],
        {"_before": ("sum", F.length("line") + 1)},
        inclusive=False,
    )
    fits = F.col("_before") + F.length("line") <= cap
    kept = F.sort_array(F.collect_list(F.when(fits, F.struct(F.col(order).alias("o"), F.col("line").alias("t")))))
    return (
        summed.groupBy("video_id")
        .agg(kept.alias("_kept"), F.bool_or(~fits).alias("truncated"))
        .select(
            "video_id",
            F.array_join(
                F.concat(
                    F.transform("_kept", lambda x: x["t"]),
                    F.when(F.col("truncated"), F.array(F.lit(fv.TRANSCRIPT_CAP_LINE))).otherwise(
                        F.array().cast("array<string>")
                    ),
                ),
                "\n",
            ).alias("transcript"),
            "truncated",
        )
    )


def transcript_stats(entries: DataFrame, order: str = "seg_idx") -> DataFrame:
    """Segments, words and covered seconds per video (``start, end, text``)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return entries.groupBy("video_id").agg(
        F.count("*").alias("n_segments"),
        F.sum(words).alias("n_words"),
        F.round(F.max_by("end", order) - F.min_by("start", order), 3).alias("covered_sec"),
    )


def window_word_loss(words: DataFrame, other: DataFrame, seconds: int = 50) -> DataFrame:
    """Share of words missing per time window between two transcripts of the same audio.

    Totals hide losses inside a window. Both sides are counted per window before they meet.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("video_id", F.floor(F.col("start") / seconds).alias("window")).agg(F.count("*").alias(name))

    both = counted(words, "n_words").join(counted(other, "n_other"), ["video_id", "window"], "full")
    base = F.coalesce("n_words", F.lit(0))
    found = F.coalesce("n_other", F.lit(0))
    return both.select(
        "video_id",
        "window",
        base.alias("n_words"),
        found.alias("n_other"),
        F.round(F.greatest(base - found, F.lit(0)) / F.greatest(base, F.lit(1)), 6).alias("loss"),
    )
