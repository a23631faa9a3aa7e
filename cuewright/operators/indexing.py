"""Keeping the chunk index current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.operators import chunking, retrieval
from cuewright.operators.catalogue import stale_index
from cuewright.session import passing_tables, written_once
from cuewright.sources import sinks


def stored_stamps(spark: SparkSession, path: str) -> DataFrame | None:
    """Metadata of one stored chunk per video, or None without an index."""
    if not sinks._exists(spark, path):
        return None
    stamp = F.struct("rag_version", "start", "end", "embedding_provider", "embedding_model")
    chunks = spark.read.parquet(path)
    return chunks.groupBy("video_id").agg(F.min_by(stamp, "chunk_pos").alias("s")).select("video_id", "s.*")


def content_hashes(segments: DataFrame) -> DataFrame:
    """video_id, content_hash, n_lines: equal where a video has the same lines, in whatever order they come."""
    line = F.xxhash64("seg_idx", "start", "end", "text")
    sums = segments.groupBy("video_id").agg(F.bit_xor(line).alias("x"), F.count("*").alias("n_lines"))
    return sums.select("video_id", F.xxhash64("x", "n_lines").alias("content_hash"), "n_lines")


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}_manifest"


def incremental_index(
    segments: DataFrame, path: str, provider: str = "hashing", model: str = "tf-256", make_encoder=None
) -> DataFrame:
    """Chunk, encode and store the videos that are missing, stale or changed; returns them with the reason.

    ``segments``: ``video_id, seg_idx, start, end, text``, all lines of each video in it. A manifest beside the index
    holds the hash of every indexed video's lines; chunks of a video that has become empty go. An index without a
    manifest counts as unchanged.
    """
    with passing_tables(segments.sparkSession) as keep:
        return keep(_index(segments, path, provider, model, make_encoder))


def _index(segments: DataFrame, path: str, provider: str, model: str, make_encoder) -> DataFrame:
    spark = segments.sparkSession
    wanted = written_once(content_hashes(segments), "wanted")
    stamps, known = stored_stamps(spark, path), manifest_path(path)
    if stamps is None:
        todo = wanted.select("video_id").withColumn("reason", F.lit("missing"))
    else:
        if sinks._exists(spark, known):
            listed = spark.read.parquet(known).select("video_id", "content_hash", "rag_version", "embedding_provider", "embedding_model")
            zero = F.lit(0).cast(stamps.schema["start"].dataType)
            empty = listed.join(stamps, "video_id", "left_anti").withColumns({"start": zero, "end": zero})
            stamps = stamps.join(listed.select("video_id", "content_hash"), "video_id", "left").unionByName(empty)
        else:
            stamps = stamps.withColumn("content_hash", F.lit(None).cast("long"))
        same = wanted.select("video_id", F.col("content_hash").alias("now"))
        stamps = stamps.join(same, "video_id", "left").withColumn("content_hash", F.coalesce("content_hash", "now")).drop("now")
        todo = stale_index(wanted.select("video_id", "content_hash"), stamps, provider, model)
    todo = written_once(todo, "todo")
    if not todo.isEmpty():
        chunks = chunking.chunk_segments(segments.join(todo, "video_id", "left_semi"))
        sinks.write_chunks(retrieval.embed_chunks(chunks, provider, model, make_encoder), path, replaced=todo)
        stamp = {"rag_version": F.lit(fv.RAG_VERSION), "embedding_provider": F.lit(provider), "embedding_model": F.lit(model)}
        sinks.upsert_by_video(wanted.join(todo.select("video_id"), "video_id", "left_semi").withColumns(stamp), known)
    return todo


def lines_path(path: str) -> str:
    return f"{path.rstrip('/')}_lines"


def append_and_index(segments: DataFrame, path: str, delivery: int, **options) -> DataFrame:
    """Add a delivery of lines to the line store, then index the videos it touches from all their lines.

    A line that comes again (same ``seg_idx``) replaces the older one, and a replayed delivery changes nothing.
    """
    with passing_tables(segments.sparkSession) as keep:
        return keep(_append(segments, path, delivery, **options))


def _append(segments: DataFrame, path: str, delivery: int, **options) -> DataFrame:
    spark, store = segments.sparkSession, lines_path(path)
    fresh = segments.select("video_id", "seg_idx", "start", "end", "text").withColumn("delivery", F.lit(delivery).cast("long"))
    if sinks._exists(spark, store):
        old = spark.read.parquet(store).drop("bucket")
        fresh = old.join(fresh.select("video_id").distinct(), "video_id", "left_semi").unionByName(fresh)
    newest = fresh.groupBy("video_id", "seg_idx").agg(F.max_by(F.struct("start", "end", "text", "delivery"), "delivery").alias("r"))
    lines = written_once(newest.select("video_id", "seg_idx", "r.*"), "lines")
    sinks.upsert_by_video(lines, store)
    return incremental_index(lines.drop("delivery"), path, **options)
