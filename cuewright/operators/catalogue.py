"""Library, drafts, sources, indexes and small configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions import numbers as num
from cuewright.functions.text import filled, squeeze
from cuewright.plans.sizes import broadcast_if_small


def asr_descriptor(
    df: DataFrame, presets: DataFrame, preset: str, *, default_preset: str, default_engine: str, default_model: str
) -> DataFrame:
    """``engine:model:device:compute`` of a preset; unknown parts say so."""
    chosen = df.withColumn("_preset", F.coalesce(filled(F.col(preset)), F.lit(default_preset)))
    joined = chosen.join(broadcast_if_small(presets.withColumnRenamed("id", "_preset")), "_preset", "left")
    part = lambda name, default: F.coalesce(filled(F.col(name)), F.lit(default))
    return joined.withColumn(
        "descriptor",
        F.concat_ws(
            ":", part("engine", default_engine), part("model", default_model), part("device", "unknown"), part("compute", "unknown")
        ),
    )


def min_threshold(tiers: DataFrame) -> DataFrame:
    """Lowest threshold of each option."""
    return tiers.groupBy("option_id").agg(F.min("threshold").alias("min_threshold"))


def distinct_keys(listing: DataFrame, key: str = "video_id", newest: str = "mtime") -> DataFrame:
    """Each key once, with its newest modification time (partial aggregation before the shuffle)."""
    return listing.groupBy(key).agg(F.max(newest).alias(newest))


def _card(channel_first: Column | None = None) -> list[Column]:
    return [
        F.col("video_id"),
        F.coalesce(filled(F.col("title")), F.col("video_id")).alias("title"),
        F.coalesce(filled(F.col("channel")), F.lit("—")).alias("channel"),
        F.col("view_count"),
        F.col("duration"),
    ]


def list_library(outputs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Finished videos with their metadata or defaults, newest first."""
    finished = distinct_keys(outputs)
    return (
        finished.join(metadata, "video_id", "left")
        .select(*_card(), F.col("mtime").alias("updated_at"))
        .orderBy(F.col("updated_at").desc(), "video_id")
    )


def list_drafts(metadata: DataFrame, transcripts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Videos with metadata and a transcript but no finished output, newest first."""
    loaded = distinct_keys(transcripts).withColumnRenamed("mtime", "transcript_mtime")
    return (
        metadata.join(outputs.select("video_id"), "video_id", "left_anti")
        .join(loaded, "video_id")
        .select(*_card(), F.greatest("mtime", "transcript_mtime").alias("updated_at"))
        .orderBy(F.col("updated_at").desc(), "video_id")
    )


def pending_work(requested: DataFrame, manifest: DataFrame, key: str = "video_id") -> DataFrame:
    """Requested keys without an output yet."""
    return requested.join(manifest.select(key), key, "left_anti")


def pick_transcript_source(candidates: DataFrame) -> DataFrame:
    """Best source per video: lowest ``priority``, then ``lang_rank``; one aggregation, no window."""
    rank = F.struct("priority", "lang_rank", "source")
    return candidates.groupBy("video_id").agg(
        F.min_by("source", rank).alias("source"), F.min_by("lang", rank).alias("lang"), F.min_by("n_rows", rank).alias("n_rows")
    )


def overlay_glossary(builtin: dict[str, str], user_entries: DataFrame) -> DataFrame:
    """Built-in entries overlaid by user entries (``written, spoken``); blank sides are dropped."""
    from cuewright.functions.text import strip

    spark = user_entries.sparkSession
    base = spark.createDataFrame(list(builtin.items()), "written string, spoken string").withColumn("priority", F.lit(1))
    user = user_entries.select(
        strip(F.col("written")).alias("written"), strip(F.col("spoken")).alias("spoken"), F.lit(0).alias("priority")
    ).where((F.col("written") != "") & (F.col("spoken") != ""))
    return (
        base.unionByName(user).groupBy("written").agg(F.min_by("spoken", F.struct("priority", "spoken")).alias("spoken"))
    )


def stale_index(wanted: DataFrame, indexed: DataFrame, provider: str, model: str, version: str = fv.RAG_VERSION) -> DataFrame:
    """Videos whose stored index is missing or was built with another version, encoder or without times.

    ``indexed`` has one stored chunk's metadata per video. An optional ``content_hash`` on both
    sides also catches changed text.
    """
    stamped = indexed.withColumnRenamed("content_hash", "stored_hash") if "content_hash" in indexed.columns else indexed
    joined = wanted.join(stamped, "video_id", "left")
    fresh = (
        F.col("rag_version").eqNullSafe(version)
        & F.col("start").isNotNull()
        & F.col("end").isNotNull()
        & F.col("embedding_provider").eqNullSafe(provider)
        & F.col("embedding_model").eqNullSafe(model)
    )
    if "stored_hash" in stamped.columns and "content_hash" in wanted.columns:
        fresh = fresh & F.col("stored_hash").eqNullSafe(F.col("content_hash"))
    reason = F.when(F.col("rag_version").isNull() & F.col("embedding_provider").isNull(), "missing").otherwise("stale")
    return joined.where(~fresh).select("video_id", reason.alias("reason"))


def backfill_chapters(metadata: DataFrame, fresh: DataFrame) -> DataFrame:
    """Refresh only records without ``chapters``; the others pass through untouched."""
    lacking = F.col("chapters").isNull()
    kept = metadata.where(~lacking)
    filled_in = (
        metadata.where(lacking)
        .drop("chapters", "chapters_source")
        .join(fresh.select("video_id", "chapters", "chapters_source"), "video_id", "left")
    )
    return kept.unionByName(filled_in)


def delete_videos(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, deleted count per id)`` of one artifact table; malformed ids are ignored here."""
    wanted = ids.where(F.col("video_id").rlike("^[A-Za-z0-9_-]+$")).select("video_id").distinct()
    kept = table.join(wanted, "video_id", "left_anti")
    deleted = table.join(wanted, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("deleted"))
    return kept, deleted


def delete_report(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Deleted rows per requested id over all artifact tables, with an error where nothing went."""
    counts = None
    for name, table in tables.items():
        part = delete_videos(table, ids)[1].withColumn("artifact", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    per_id = counts.groupBy("video_id").agg(F.sum("deleted").alias("deleted"), F.count("*").alias("artifacts"))
    valid = F.col("video_id").rlike("^[A-Za-z0-9_-]+$")
    return (
        ids.select("video_id")
        .distinct()
        .join(per_id, "video_id", "left")
        .select(
            "video_id",
            F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"),
            F.coalesce("artifacts", F.lit(0)).cast("long").alias("artifacts"),
            F.when(~valid, "bad_id").when(F.col("deleted").isNull(), "not_found").alias("error"),
        )
    )


def build_metadata(info: DataFrame) -> DataFrame:
    """Stored metadata fields from downloader records, renamed; chapters join separately."""
    same = (
        "title channel_id thumbnail description duration view_count like_count comment_count "
        "channel_follower_count upload_date categories tags webpage_url chapters chapters_source"
    ).split()
    have = set(info.columns)
    typed = {"categories": "array<string>", "tags": "array<string>", "duration": "double"}
    return info.select(
        F.col("id").alias("video_id"),
        F.col("uploader").alias("channel"),
        F.col("uploader_url").alias("channel_url"),
        *[F.col(c) if c in have else F.lit(None).cast(typed.get(c, "string")).alias(c) for c in same],
    )


def attach_chapter_titles(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """Translated titles by position, all or nothing per video.

    Counts and blanks are aggregated per video first, so the guard costs one small aggregate.
    """
    clean = titles.withColumn("title_vi", squeeze(F.coalesce("title_vi", F.lit(""))))
    have = clean.groupBy("video_id").agg(
        F.count("*").alias("n_titles"), F.count_if(F.col("title_vi") == "").alias("n_blank")
    )
    need = chapters.groupBy("video_id").agg(F.count("*").alias("n_chapters"))
    verdict = need.join(have, "video_id", "left").select(
        "video_id",
        F.when(F.coalesce("n_titles", F.lit(0)) != F.col("n_chapters"), "title_count")
        .when(F.col("n_blank") > 0, "blank_title")
        .alias("error"),
    )
    return (
        chapters.join(clean.select("video_id", "chapter_idx", "title_vi"), ["video_id", "chapter_idx"], "left")
        .join(verdict, "video_id")
        .withColumn("title_vi", F.when(F.col("error").isNull(), F.col("title_vi")))
    )


def dubbing_metadata(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Summary struct of the latest run of each video (``metadata.latest_run_id``)."""
    asr = num.clean_null(F.col("asr_engine"))
    manual = asr == "manual_sub"
    joined = metadata.join(runs.withColumnRenamed("run_id", "latest_run_id").drop("video_id"), "latest_run_id", "left")
    batch = F.when(F.lower("engine") == "omnivoice", F.when(F.col("batch_size") > 0, F.col("batch_size").cast("string")))
    mode = F.when(F.col("translation_mode").isin("api", "manual"), F.col("translation_mode"))
    summary = F.struct(
        F.col("latest_run_id").alias("run_id"),
        F.struct(
            F.col("engine").alias("engine"),
            num.engine_label(F.col("engine")).alias("engine_label"),
            F.coalesce(num.clean_null(F.col("tts_batch_size")), batch).alias("batch_size"),
        ).alias("tts"),
        F.struct(
            F.when(manual, "manual_sub").when(asr.isNotNull(), "whisper").alias("source"),
            F.when(~manual, asr).alias("engine"),
            num.clean_null(F.col("asr_time_sec")).alias("time_sec"),
        ).alias("asr"),
        F.struct(mode.alias("mode")).alias("translation"),
        F.struct(
            num.clean_null(F.col("mode")).alias("mode"),
            num.clean_null(F.col("tts_time_sec")).alias("tts_time_sec"),
            num.clean_null(F.col("total_time_sec")).alias("total_time_sec"),
        ).alias("run"),
    )
    return joined.select("video_id", summary.alias("dubbing"))


def run_details(dubbing: DataFrame) -> DataFrame:
    """Label / value rows describing a run; blank values are left out."""

    def seconds(name: str, prefix: str) -> Column:
        value = F.col(name).try_cast("double")
        return F.when(value.isNotNull() & ~F.isnan(value), F.format_string(prefix + " %.1fs", value))

    d = "dubbing"
    took = F.concat_ws(
        " · ", seconds(f"{d}.run.tts_time_sec", "TTS"), seconds(f"{d}.run.total_time_sec", "Tổng")
    )
    rows = F.array(
        F.struct(F.lit("TTS engine").alias("label"), F.col(f"{d}.tts.engine_label").alias("value")),
        F.struct(F.lit("Batch TTS").alias("label"), F.col(f"{d}.tts.batch_size").alias("value")),
        F.struct(
            F.when(F.col(f"{d}.asr.source") == "manual_sub", "Phụ đề nguồn").otherwise("ASR").alias("label"),
            F.when(F.col(f"{d}.asr.source") == "manual_sub", "manual sub").otherwise(F.col(f"{d}.asr.engine")).alias("value"),
        ),
        F.struct(F.lit("Dịch").alias("label"), F.col(f"{d}.translation.mode").alias("value")),
        F.struct(F.lit("Thời gian xử lý").alias("label"), took.alias("value")),
        F.struct(F.lit("Run ID").alias("label"), F.col(f"{d}.run_id").alias("value")),
    )
    return (
        dubbing.select("video_id", F.inline(rows)).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    )


def sweep_compare(runs: DataFrame) -> DataFrame:
    """Per model: baseline (batch 1) against its largest batch; two ``min_by`` picks, no pivot."""
    row = F.struct("elapsed", "n_segments", "n_words", "covered")
    best = runs.groupBy("model").agg(
        F.min_by(F.when(F.col("batch") == 1, row), F.when(F.col("batch") == 1, F.col("batch"))).alias("base"),
        F.max_by(row, "batch").alias("top"),
        F.max("batch").alias("max_batch"),
    )

    def gap(name: str, floor: float) -> Column:
        base, top = F.col(f"base.{name}"), F.col(f"top.{name}")
        return F.round(F.abs(top - base) / F.greatest(base, F.lit(floor)) * 100, 4)

    return best.where(F.col("base").isNotNull() & (F.col("max_batch") > 1)).select(
        "model",
        "max_batch",
        F.round((F.col("base.elapsed") / F.greatest(F.col("top.elapsed"), F.lit(0.01)) - 1) * 100, 4).alias("speed_gain"),
        gap("n_segments", 1.0).alias("segment_diff"),
        gap("n_words", 1.0).alias("word_diff"),
        gap("covered", 0.01).alias("coverage_diff"),
    )
