"""Loudness over sample tables ``clip_id, i, x``: frames, silences, trims, active range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.plans.blocked import (
    block_window,
    drop_halo,
    many_blocks,
    running,
    value_rank,
    with_halo,
)
from cuewright.plans.sizes import broadcast_if_small


def frame_samples(sample_rate: int, frame_ms: int = fv.FRAME_MS) -> int:
    return max(1, int(sample_rate * frame_ms / 1000))


def frame_rms(samples: DataFrame, sample_rate: int) -> DataFrame:
    """Root mean square per full frame; the ragged tail is dropped. Sums combine before the shuffle."""
    frame = frame_samples(sample_rate)
    energy = F.avg(F.col("x") * F.col("x"))
    return (
        samples.groupBy("clip_id", F.floor(F.col("i") / frame).cast("long").alias("frame_idx"))
        .agg(F.count("*").alias("_n"), F.sqrt(energy + 1e-9).alias("rms"))
        .where(F.col("_n") == frame)
        .drop("_n")
    )


def silence_runs(samples: DataFrame, sample_rate: int, silence_db: float = fv.SILENCE_DB) -> DataFrame:
    """Stretches of frames below the threshold, as sample positions ``start, end`` per clip.

    The threshold follows the loudest frame of the clip.
    """
    frame = frame_samples(sample_rate)
    frames = frame_rms(samples, sample_rate)
    level = frames.groupBy("clip_id").agg((F.greatest(F.max("rms"), F.lit(1e-6)) * 10 ** (silence_db / 20)).alias("limit"))
    quiet = frames.join(broadcast_if_small(level), "clip_id").withColumn("_quiet", F.col("rms") < F.col("limit"))
    many = many_blocks(samples, F.floor(F.col("i") / frame))
    before = F.lag("_quiet").over(block_window(["clip_id"], "frame_idx", many=many))
    edges = drop_halo(
        with_halo(quiet, "frame_idx", before=1, many=many, dense=True).withColumn(
            "_opens", F.col("_quiet") & ~F.coalesce(before, F.lit(False))
        )
    )
    named = running(
        edges, ["clip_id"], ["frame_idx"], {"_run": ("last", F.when(F.col("_opens"), F.col("frame_idx")))}, many=many
    )
    return (
        named.where("_quiet")
        .groupBy("clip_id", "_run")
        .agg(F.count("*").alias("frames"))
        .select(
            "clip_id", (F.col("_run") * frame).alias("start"), ((F.col("_run") + F.col("frames")) * frame).alias("end")
        )
    )


def silence_trim_plan(
    runs: DataFrame,
    clips: DataFrame,
    sample_rate: int,
    min_pause: float = fv.SILENCE_MIN_PAUSE,
    protect_ratio: float = fv.PROTECT_RATIO,
    protect_multiplier: float = fv.PROTECT_MULTIPLIER,
) -> DataFrame:
    """Samples to cut from each silence so that a clip fits (``clips``: ``clip_id, n_samples, target``).

    The longest silences keep a higher floor; the cut is shared in proportion to what each can lose.
    """
    sized = runs.select("clip_id", "start", "end", (F.col("end") - F.col("start")).alias("size"))
    placed = value_rank(sized, ["clip_id"], "size", "start", descending=True, name="_rank")
    totals = sized.groupBy("clip_id").agg(F.count("*").alias("_runs"))
    protect = F.when(F.col("_runs") > 1, F.bround(F.col("_runs") * protect_ratio)).otherwise(0)
    low, high = int(sample_rate * min_pause), int(sample_rate * min_pause * protect_multiplier)
    floors = (
        placed.join(totals, "clip_id")
        .withColumn("_floor", F.when(F.col("_rank") < protect, high).otherwise(low))
        .withColumn("trimmable", F.greatest(F.lit(0), F.col("size") - F.col("_floor")).cast("long"))
    )
    budget = floors.groupBy("clip_id").agg(F.sum("trimmable").alias("_total"))
    removable = F.least(F.col("n_samples") - F.col("target"), F.col("_total"))
    return (
        floors.join(budget, "clip_id")
        .join(clips, "clip_id")
        .where((F.col("n_samples") > F.col("target")) & (F.col("_total") > 0))
        .select(
            "clip_id",
            "start",
            "end",
            "trimmable",
            F.bround(removable * F.col("trimmable") / F.col("_total")).cast("long").alias("cut"),
        )
    )


def active_range(
    samples: DataFrame,
    sample_rate: int,
    silence_db: float = fv.ACTIVE_DB,
    head_ms: float = fv.ACTIVE_HEAD_MS,
    tail_ms: float = fv.ACTIVE_TAIL_MS,
) -> DataFrame:
    """First to last loud frame per clip with padding, clamped; the whole clip when nothing is loud.

    The threshold follows the loudest single sample.
    """
    frame = frame_samples(sample_rate)
    clips = samples.groupBy("clip_id").agg((F.max("i") + 1).alias("n"), F.max(F.abs("x")).alias("peak"))
    loud = (
        frame_rms(samples, sample_rate)
        .join(broadcast_if_small(clips.select("clip_id", "peak")), "clip_id")
        .where(F.col("rms") >= F.col("peak") * 10 ** (silence_db / 20))
        .groupBy("clip_id")
        .agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    )
    found = F.col("first").isNotNull() & (F.col("peak") > 1e-6)
    start = (F.col("first") * frame - sample_rate * head_ms / 1000).cast("long")
    end = ((F.col("last") + 1) * frame + sample_rate * tail_ms / 1000).cast("long")
    clamped = F.greatest(F.lit(0).cast("long"), F.least(start, F.col("n")))
    return (
        clips.join(loud, "clip_id", "left")
        .withColumn("start", F.when(found, clamped).otherwise(F.lit(0).cast("long")))
        .select(
            "clip_id",
            "start",
            F.when(found, F.least(F.col("n"), F.greatest(F.col("start") + frame, end))).otherwise(F.col("n")).alias("end"),
        )
    )
