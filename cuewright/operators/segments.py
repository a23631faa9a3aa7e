"""Grouping neighbouring segments and choosing a voice sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions.text import filled, reference_text, strip
from cuewright.plans.blocked import (
    BLOCK_ROWS,
    block_of,
    block_window,
    drop_halo,
    many_blocks,
    running,
    with_halo,
)
from cuewright.plans.folds import run_fold


class MergeFold:
    """Marks the segments that open a new group; the state is the size of the open group.

    Sizes above the limit behave alike, so there are ``max_chars + 2`` states. -1 is "no group yet".
    """

    columns = ("size", "near")
    before = after = 0
    initial = -1

    def __init__(self, max_chars: int):
        self.max_chars = max_chars

    def entry_states(self, low):
        return range(self.max_chars + 2)

    def fold(self, rows, low, high, state, out):
        for i, (size, near) in enumerate(zip(rows["size"].tolist(), rows["near"].tolist())):
            joins = state >= 0 and near and state + size <= self.max_chars
            state = min(self.max_chars + 1, (state if joins else 0) + size)
            if out is not None:
                out.append((i, not joins))
        return state


def merge_segments(
    segments: DataFrame,
    max_chars: int,
    gap_seconds: float = fv.MERGE_GAP_SECONDS,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy groups of neighbours at most ``gap_seconds`` apart and ``max_chars`` long together."""
    many = many_blocks(segments, "seg_idx", size)
    spoken = F.coalesce(filled(F.col("text_tts")), filled(F.col("text_vi")), filled(F.col("text")), F.lit(""))
    shown = F.coalesce(filled(F.col("text_vi")), filled(F.col("text_tts")), filled(F.col("text")), F.lit(""))
    previous_end = F.lag(F.col("start") + F.col("duration")).over(
        block_window(["video_id"], "seg_idx", many=many)
    )
    near = F.coalesce(F.abs(F.col("start") - previous_end) <= gap_seconds, F.lit(False))
    prepared = drop_halo(
        with_halo(segments, "seg_idx", before=1, size=size, many=many).withColumns(
            {
                "near": near,
                "size": F.length(spoken),
                "shown": strip(shown),
                "tts": strip(F.coalesce("text_tts", F.lit(""))),
            }
        )
    )
    member = ["seg_idx", "shown", "tts", "start", "duration"]
    marked = run_fold(
        prepared.select("video_id", "size", "near", *member),
        ["video_id"],
        "seg_idx",
        lambda: MergeFold(max_chars),
        "opens boolean",
        keep=member,
        size=size,
        many=many,
    )
    grouped = running(
        marked.withColumn("_blk", block_of("seg_idx", size)),
        ["video_id"],
        ["seg_idx"],
        {"group_start": ("last", F.when(F.col("opens"), F.col("seg_idx")))},
        many=many,
    )
    gathered = grouped.groupBy("video_id", "group_start").agg(
        F.sort_array(F.collect_list(F.struct(*member))).alias("m")
    )
    first, last = F.element_at("m", 1), F.element_at("m", -1)
    return gathered.select(
        "video_id",
        "group_start",
        F.transform("m", lambda x: x["seg_idx"]).alias("source_indices"),
        F.transform("m", lambda x: x["shown"]).alias("source_texts"),
        strip(F.array_join(F.transform("m", lambda x: x["tts"]), " ")).alias("text_tts"),
        first["start"].alias("start"),
        (last["start"] + last["duration"] - first["start"]).alias("duration"),
    )


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def reference_window(segments: DataFrame) -> DataFrame:
    """The stretch of 3 to 10 seconds per video that suits best as a voice sample.

    Each segment looks at itself and seven followers through a bounded row frame; the best stretch
    per video is a plain minimum. Without one, the first long segment is cut to seven seconds.
    """
    source_texts = F.col("source_texts") if "source_texts" in segments.columns else F.array().cast("array<string>")
    text = reference_text(F.col("text"), F.col("text_tts"), F.col("text_vi"), source_texts)
    length = F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0)))
    item = F.struct(F.col("start").alias("s"), (F.col("start") + length).alias("e"), text.alias("t"))
    ahead = fv.REFERENCE_SEGMENTS - 1
    many = many_blocks(segments, "seg_idx")
    frame = block_window(["video_id"], "seg_idx", many=many).rowsBetween(Window.currentRow, ahead)
    prepared = with_halo(segments.withColumns({"_item": item, "_len": length}), "seg_idx", after=ahead, many=many)
    near = drop_halo(prepared.withColumn("_items", F.collect_list("_item").over(frame)))

    best_type = "struct<score:double,duration:double,text:string>"
    start = F.struct(
        F.col("start").alias("reached"),
        F.lit(0.0).alias("gaps"),
        F.lit("").alias("text"),
        F.lit(False).alias("stop"),
        F.lit(None).cast(best_type).alias("best"),
    )

    def grow(acc: Column, x: Column) -> Column:
        begun = acc["text"] != ""
        pause = x["s"] - acc["reached"]
        broken = acc["stop"] | (begun & (pause > fv.REFERENCE_MAX_GAP))
        gaps = acc["gaps"] + F.when(begun, F.greatest(F.lit(0.0), pause)).otherwise(0.0)
        said = F.when(x["t"] == "", acc["text"]).when(begun, F.concat(acc["text"], F.lit(" "), x["t"])).otherwise(x["t"])
        reached = F.greatest(acc["reached"], x["e"])
        span = reached - F.col("start")
        stop = broken | (span > fv.REFERENCE_MAX_SECONDS)
        score = F.abs(span - fv.REFERENCE_TARGET_SECONDS) + gaps * 2.0
        usable = ~stop & (span >= fv.REFERENCE_MIN_SECONDS) & (_letters(said) >= fv.REFERENCE_MIN_LETTERS)
        better = usable & (acc["best"].isNull() | (score < acc["best"]["score"]))
        found = F.struct(score.alias("score"), span.alias("duration"), said.alias("text")).cast(best_type)
        return F.struct(
            reached.alias("reached"),
            gaps.alias("gaps"),
            said.alias("text"),
            stop.alias("stop"),
            F.when(better, found).otherwise(acc["best"]).alias("best"),
        )

    best = F.aggregate("_items", start, grow, lambda acc: acc["best"])
    keep = F.greatest(F.lit(1), F.floor(F.length("_item.t") * (F.col("_target") / F.col("_len"))).cast("int"))
    cut = F.substring(F.col("_item.t"), F.lit(1), keep)
    shorter = F.coalesce(filled(F.regexp_replace(cut, r" [^ ]*$", "")), cut)
    alone = F.when(
        (F.col("_len") >= fv.REFERENCE_MIN_SECONDS) & (_letters(F.col("_item.t")) >= fv.REFERENCE_MIN_LETTERS),
        F.struct(
            "seg_idx",
            "start",
            F.col("_target").alias("duration"),
            F.when(F.col("_target") < F.col("_len"), shorter).otherwise(F.col("_item.t")).alias("text"),
        ),
    )
    judged = near.withColumn("_target", F.least("_len", F.lit(fv.REFERENCE_TARGET_SECONDS))).select(
        "video_id", "seg_idx", "start", best.alias("_best"), alone.alias("_alone")
    )
    ranked = F.when(
        F.col("_best").isNotNull(),
        F.struct(F.col("_best.score").alias("score"), "seg_idx", "start", F.col("_best.duration").alias("duration"), F.col("_best.text").alias("text")),
    )
    picked = judged.groupBy("video_id").agg(F.min(ranked).alias("a"), F.min("_alone").alias("b"))
    return picked.where(F.col("a").isNotNull() | F.col("b").isNotNull()).select(
        "video_id",
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("start", "duration", "text")],
    )
