"""Translation flow: batches, prompts, normalised answers, retries, attaching."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions import numbers as num
from cuewright.functions import spoken
from cuewright.functions.text import spoken_units, strip
from cuewright.operators.timing import clear_timing
from cuewright.plans.blocked import BLOCK_ROWS, block_of, dense_position, many_blocks, ordered_text, running
from cuewright.plans.folds import run_fold

# Our own wording; callers may pass theirs with the same placeholders.
PROMPT_TEMPLATE = """Translate the numbered subtitle lines into Vietnamese for dubbing.
Title: {title}
Channel: {channel}
First line of the answer: {header}
One answer line per source line, same numbers, same order; stay inside each [A-B tiếng] range.

""" + fv.SOURCE_MARKER + """
{data}"""
CHAPTER_TEMPLATE = """Translate the chapter titles into Vietnamese.
Title: {title}
Channel: {channel}
First line of the answer: """ + fv.CHAPTER_HEADER + """

""" + fv.SOURCE_MARKER + """
""" + fv.CHAPTER_HEADER + """
{data}"""


def expansion_units(text: Column, glossary: Mapping[str, str] | None = None) -> Column:
    """Extra syllables the spoken form needs over the written one."""
    said = spoken.normalize_text(text, glossary)["text"]
    return F.greatest(F.lit(0).cast("long"), spoken_units(said) - spoken_units(text))


def line_bodies(segments: DataFrame, glossary: Mapping[str, str] | None = None) -> DataFrame:
    """Batch line of each segment without its number: range label and text."""
    surcharge = expansion_units(F.coalesce("text", F.lit("")), glossary)
    budget = F.greatest(F.lit(2).cast("long"), num.syllable_budget(F.col("duration")) - surcharge)
    return segments.select("video_id", "seg_idx", budget.alias("budget"), "text").select(
        "video_id",
        "seg_idx",
        "budget",
        F.concat_ws(" ", num.budget_label(F.col("budget")), F.coalesce("text", F.lit(""))).alias("body"),
    )


class BatchFold:
    """Fill a batch up to a line and a character limit; the state is the batch's first line."""

    columns = ("size",)
    before = initial = 0

    def __init__(self, lines: int, chars: int):
        self.lines, self.chars, self.after = lines, chars, lines

    def entry_states(self, low):
        return range(low, low + self.lines + 1)

    def fold(self, rows, low, high, state, out):
        first, sizes = int(rows["pos"][0]), rows["size"]
        at, count = state - first, len(sizes)
        while at < high - first:
            stop = min(at + self.lines, count)
            numbers = np.arange(1, stop - at + 1)
            # "n. " in front of the body and a line break behind it.
            used = np.cumsum(sizes[at:stop] + np.char.str_len(numbers.astype(str)) + 3)
            taken = max(1, int(np.searchsorted(used, self.chars, side="right"))) if self.chars else stop - at
            taken = min(taken, stop - at)
            if taken < 1:
                raise ValueError("rows must be numbered without gaps")
            if out is not None:
                out.extend((at + k, k + 1, k == 0) for k in range(taken))
            at += taken
        return first + at


def batch_lines(
    bodies: DataFrame, batch_size: int = fv.MANUAL_BATCH_SIZE, max_chars: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``batch_no`` (1-based), ``line_no`` and the numbered ``line``.

    Rows are counted as they come in order of ``seg_idx``; the index may start anywhere and have gaps.
    """
    batch_size = max(1, int(batch_size or 1))
    many = many_blocks(bodies, "seg_idx", size)
    numbered = dense_position(bodies, ["video_id"], ["seg_idx"], block_of("seg_idx", size), "pos", many)
    if not max_chars:
        placed = numbered.withColumns(
            {
                "batch_no": F.floor(F.col("pos") / batch_size).cast("long") + 1,
                "line_no": (F.col("pos") % batch_size).cast("long") + 1,
            }
        ).drop("pos")
    else:
        many = many or many_blocks(numbered, "pos", size)
        marked = run_fold(
            numbered.withColumn("size", F.length("body")),
            ["video_id"],
            "pos",
            lambda: BatchFold(batch_size, max_chars),
            "line_no long, opens boolean",
            keep=[c for c in bodies.columns if c != "video_id"],
            size=max(size, batch_size),
            many=many,
        )
        placed = running(
            marked.withColumn("_blk", block_of("seg_idx", size)),
            ["video_id"],
            ["seg_idx"],
            {"batch_no": ("sum", F.col("opens").cast("long"))},
            many=many,
        ).drop("opens", "_blk")
    return placed.withColumn("line", F.concat(F.col("line_no"), F.lit(". "), F.col("body")))


def translation_batches(lines: DataFrame) -> DataFrame:
    """One text per batch: header, blank line, numbered lines (a batch is at most a few hundred lines)."""
    texts = ordered_text(lines, ["video_id", "batch_no"], "line_no", "line", "\n", part_rows=1 << 62, name="body").drop("part")
    header = F.concat(F.lit("[batch_"), F.col("batch_no"), F.lit("]"))
    return texts.select(
        "video_id", "batch_no", header.alias("header"), F.concat(header, F.lit("\n\n"), F.col("body")).alias("data")
    )


def _rendered(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders; inserted text is never scanned for placeholders itself."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def render_prompts(batches: DataFrame, metadata: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """Prompt per batch with the video's title and channel."""
    cards = metadata.select("video_id", "title", "channel")
    text = _rendered(
        template,
        title=F.coalesce("title", F.lit("")),
        channel=F.coalesce("channel", F.lit("")),
        header=F.col("header"),
        data=F.col("data"),
    )
    return batches.join(cards, "video_id", "left").select("video_id", "batch_no", text.alias("prompt"))


def render_chapter_prompts(chapters: DataFrame, metadata: DataFrame, template: str = CHAPTER_TEMPLATE) -> DataFrame:
    """Prompt per video with chapters (``video_id, index, title``)."""
    lines = chapters.withColumn("line", F.concat(F.col("index"), F.lit(". "), strip(F.col("title"))))
    data = ordered_text(lines, ["video_id"], "index", "line", "\n", name="data")
    cards = metadata.select("video_id", "title", "channel")
    text = _rendered(
        template,
        title=strip(F.coalesce("title", F.lit(""))),
        channel=strip(F.coalesce("channel", F.lit(""))),
        data=F.col("data"),
    )
    return data.join(cards, "video_id", "left").select("video_id", "part", text.alias("prompt"))


def normalize_segments(
    rows: DataFrame,
    glossary: Mapping[str, str] | None = None,
    engine: str = "supertonic",
    text: str = "text_vi",
) -> DataFrame:
    """Display text, speech text and the report; optional columns ``budget``, ``duration``,
    ``pronunciation_map``. The budget was lowered by the expansion when the prompt was made, so the
    expansion is added back before the density is judged.
    """
    have = set(rows.columns)
    budget = F.col("budget").cast("long") if "budget" in have else F.lit(None).cast("long")
    duration = F.col("duration").cast("double") if "duration" in have else F.lit(None).cast("double")
    mapping = F.col("pronunciation_map") if "pronunciation_map" in have else F.lit(None).cast("map<string,string>")
    prepared = rows.withColumn("_p", spoken.prepare_text(F.coalesce(text, F.lit("")), mapping, glossary))
    counted = prepared.withColumns(
        {"_written": spoken_units(F.col("_p.vi")), "_spoken": spoken_units(F.col("_p.tts"))}
    ).withColumn("_extra", F.greatest(F.lit(0).cast("long"), F.col("_spoken") - F.col("_written")))
    effective = F.when(budget != 0, budget + F.col("_extra"))
    judged = counted.withColumn("_d", num.density(F.col("_spoken"), duration, effective))
    report = F.struct(
        F.lit(engine).alias("engine"),
        F.lit(fv.NORMALIZATION_VERSION).alias("version"),
        F.col("_p.rules").alias("applied_rules"),
        F.col("_written").alias("written_units"),
        F.col("_spoken").alias("spoken_units"),
        budget.alias("budget"),
        F.col("_extra").alias("normalization_expansion"),
        *[F.col(f"_d.{c}").alias(c) for c in (
            "duration", "density", "min_units", "target_units", "max_units", "base_max_units", "tolerance_units",
            "warnings", "errors",
        )],
    )
    return judged.withColumns(
        {"text_vi": F.col("_p.vi"), "text_tts": F.col("_p.tts"), "normalization": report}
    ).drop("_p", "_d", "_written", "_spoken", "_extra")


def renormalize(
    segments: DataFrame, durations: DataFrame, glossary: Mapping[str, str] | None = None, engine: str = "supertonic"
) -> DataFrame:
    """Normalise translated segments again with their real durations (``video_id, seg_idx, duration``)."""
    bare = segments.drop("duration")
    return normalize_segments(bare.join(durations, ["video_id", "seg_idx"], "left"), glossary, engine)


def apply_corrections(
    segments: DataFrame, corrections: DataFrame, glossary: Mapping[str, str] | None = None, engine: str = "supertonic"
) -> DataFrame:
    """Replace the text of corrected segments (``video_id, seg_idx, text_vi``); others stay untouched.

    Only the corrected rows run through the cascade.
    """
    fresh = normalize_segments(corrections, glossary, engine).select(
        "video_id", "seg_idx", F.col("text_vi").alias("_vi"), F.col("text_tts").alias("_tts"), F.lit(True).alias("_new")
    )
    joined = segments.join(fresh, ["video_id", "seg_idx"], "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns(
        {
            "text_vi": F.when(hit, F.col("_vi")).otherwise(F.col("text_vi")),
            "text_tts": F.when(hit, F.col("_tts")).otherwise(F.col("text_tts")),
            "corrected": hit,
        }
    ).drop("_vi", "_tts", "_new")


def attach_translations(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations by position (``video_id, seg_idx, vi, tts``); counts must agree per video.

    A plain translation without ``vi`` sets only the speech text. Old timing is cleared. Videos with
    another number of lines keep their rows and carry the error.
    """
    need = segments.groupBy("video_id").agg(F.count("*").alias("n_segments"))
    have = translations.groupBy("video_id").agg(F.count("*").alias("n_lines"))
    verdict = need.join(have, "video_id", "left").select(
        "video_id",
        F.when(
            F.coalesce("n_lines", F.lit(0)) != F.col("n_segments"),
            F.concat(F.lit("line_count:"), F.coalesce("n_lines", F.lit(0)), F.lit(":"), F.col("n_segments")),
        ).alias("error"),
    )
    lines = translations.select("video_id", "seg_idx", "vi", "tts")
    joined = clear_timing(segments).join(lines, ["video_id", "seg_idx"], "left").join(verdict, "video_id")
    good = F.col("error").isNull()
    return joined.withColumns(
        {
            "text_vi": F.when(good & F.col("vi").isNotNull(), F.col("vi")).otherwise(F.col("text_vi")),
            "text_tts": F.when(good, F.coalesce("tts", F.lit(""))).otherwise(F.col("text_tts")),
        }
    ).drop("vi", "tts")


# ---- retries -----------------------------------------------------------------------------------
def retry_split(lines: DataFrame, min_lines: int = fv.RETRY_MIN_LINES) -> DataFrame:
    """Halve every batch with more than ``min_lines`` lines (``path, depth, line_no, line, n_lines``).

    Lines are renumbered in their half; the path gains ``_r{depth}_{part}``. Smaller batches and
    those at the depth limit pass through.
    """
    half = F.ceil(F.col("n_lines") / 2).cast("long")
    split = (F.col("n_lines") > min_lines) & (F.col("depth") < fv.RETRY_MAX_DEPTH)
    second = F.col("line_no") > half
    part = F.when(second, 2).otherwise(1)
    return lines.withColumns(
        {
            "path": F.when(split, F.concat("path", F.lit("_r"), F.col("depth") + 1, F.lit("_"), part)).otherwise(F.col("path")),
            "line_no": F.when(split & second, F.col("line_no") - half).otherwise(F.col("line_no")),
            "n_lines": F.when(split, F.when(second, F.col("n_lines") - half).otherwise(half)).otherwise(F.col("n_lines")),
            "depth": F.when(split, F.col("depth") + 1).otherwise(F.col("depth")),
        }
    )


def retry_merge(lines: DataFrame) -> DataFrame:
    """Lines of all parts of a batch back in order, renumbered from 1 (``batch_key, path, line_no``).

    A part's lines are numbered from 1 already, so the offset of its part is all that is missing; it
    comes from one row per part.
    """
    sizes = lines.groupBy("batch_key", "path").agg(F.count("*").alias("n"))
    before = Window.partitionBy("batch_key").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("batch_key", "path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return (
        lines.join(offsets, ["batch_key", "path"])
        .withColumn("merged_no", (F.col("_offset") + F.col("line_no")).cast("long"))
        .drop("_offset")
    )
