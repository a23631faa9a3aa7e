"""Run log: create and update events compacted to the latest value per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.plans.blocked import dense_position, running


def run_log_state(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Latest non-null value of each column per run; partial aggregation, so a busy run is no hot task."""
    at = F.struct(*order)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    return events.groupBy(key).agg(*latest, F.count("*").alias("n_events"))


def has_run(state: DataFrame, run_ids: DataFrame, key: str = "run_id") -> DataFrame:
    """Requested runs that exist."""
    return run_ids.join(state.select(key), key, "left_semi")


def next_run_index(existing: DataFrame, requests: DataFrame, order: str, block: Column) -> DataFrame:
    """Run index and id for new requests: the largest stored index of the video plus their place.

    ``existing``: ``video_id, run_index`` (text; unreadable values are ignored).
    """
    largest = existing.groupBy("video_id").agg(F.max(F.col("run_index").try_cast("long")).alias("_last"))
    placed = dense_position(requests, ["video_id"], [order], block, "_place")
    index = F.greatest(F.coalesce("_last", F.lit(0)), F.lit(0)) + F.col("_place") + 1
    return (
        placed.join(largest, "video_id", "left")
        .withColumn("run_index", index)
        .withColumn("run_id", F.concat("video_id", F.lit("_"), F.col("run_index")))
        .drop("_last", "_place")
    )


def pause_sessions(events: DataFrame, alpha_seconds: float, bucket_seconds: int = 86_400) -> DataFrame:
    """Sessions of timed events (``video_id, event_id, ts_us``): a gap of ``alpha`` or more cuts.

    Blocks are time buckets, so a busy key spreads over tasks.
    """
    blocked = events.withColumn("_blk", F.floor(F.col("ts_us") / (bucket_seconds * 1_000_000)).cast("long"))
    order = ["ts_us", "event_id"]
    seen = running(blocked, ["video_id"], order, {"_prev": ("last", F.col("ts_us"))}, inclusive=False, many=True)
    opens = F.coalesce(F.col("ts_us") - F.col("_prev") >= int(alpha_seconds * 1_000_000), F.lit(True))
    numbered = running(
        seen.withColumn("_opens", opens.cast("long")), ["video_id"], order, {"session": ("sum", F.col("_opens"))}, many=True
    )
    return numbered.groupBy("video_id", "session").agg(
        F.count("*").alias("n_events"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")
    )


class ThrottleFold:
    """Emit a percentage only when it is at least ``step`` above the last one emitted (state)."""

    columns = ("percent",)
    before = after = 0
    initial = -1

    def __init__(self, step: int):
        self.step = step

    def entry_states(self, low):
        return range(-1, 100)

    def fold(self, rows, low, high, state, out):
        for i, percent in enumerate(rows["percent"].tolist()):
            if percent >= state + self.step:
                state = percent
                if out is not None:
                    out.append((i, percent))
        return state


def progress_throttle(progress: DataFrame, step: int = 2, **fold_options) -> DataFrame:
    """Progress rows worth reporting (``video_id, pos, end, total``): capped at 99, at least ``step`` apart."""
    from cuewright.plans.folds import run_fold

    total = F.greatest(F.lit(0.1), F.coalesce("total", F.lit(0.0)))
    raw = (F.col("end") * 100 / total).cast("long")
    percents = progress.withColumn("percent", F.greatest(F.lit(0), F.least(F.lit(99), raw)))
    return run_fold(
        percents, ["video_id"], "pos", lambda: ThrottleFold(step), "percent long", keep=["pos"], **fold_options
    )
