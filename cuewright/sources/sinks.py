"""Writers. Tables are partitioned by a hash bucket of the video, so updates touch few files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions import numbers as num
from cuewright.plans.blocked import BLOCK_ROWS, block_of
from cuewright.session import passing_tables, shuffles_freed, written_once

BUCKETS = 64
# Characters that Spark escapes in the folder of a partition value, and its folder of null and empty values.
ESCAPED, EMPTY_PARTITION = "\"#%'*/:=?\\\x7f{[]^", "__HIVE_DEFAULT_PARTITION__"


def write_files(pieces: DataFrame, path: str, order: str, separator: str = "\n", keys: tuple[str, ...] = ("video_id",)) -> None:
    """One text file per key below ``path`` (folders ``key=value``): its pieces in order, the separator after each.

    A file is written front to back by one task that streams its sorted pieces, so memory does not grow with its length; files of
    different keys are written in parallel.
    """
    laid = pieces.repartition(*keys).sortWithinPartitions(*keys, order)
    target = spark_path(pieces.sparkSession, path)
    if target.toUri().getScheme() == "file":
        _write_mounted(laid, target, separator, keys)
    else:
        laid.select(*keys, F.col("piece").alias("value")).write.mode("overwrite").option("lineSep", separator).partitionBy(*keys).text(path)


def spark_path(spark: SparkSession, path: str):
    """``path`` with the scheme that Spark would take for it."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    return raw.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(raw)


def _folder(key: str, value: str | None) -> str:
    """The folder of a partition value, as Spark writes and reads it."""
    escaped = "".join(f"%{ord(c):02X}" if c < " " or c in ESCAPED else c for c in value) if value else EMPTY_PARTITION
    return f"{key}={escaped}"


def _write_mounted(laid: DataFrame, target, separator: str, keys: tuple[str, ...]) -> None:
    """``write_files`` for a folder that all machines mount: tasks open the files themselves.

    Hadoop's local file system starts a ``chmod`` for each file, its checksum and its folders. A file gets its name when it is
    complete, so an attempt that fails leaves nothing, and a second attempt writes the same file again.
    """
    spark = laid.sparkSession
    files, root = target.getFileSystem(spark._jsc.hadoopConfiguration()), target.toUri().getPath()
    files.delete(target, True)
    files.mkdirs(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, out, aside, name, end = None, None, "", "", separator.encode()

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(aside, os.path.join(os.path.dirname(aside), name))

        try:
            for batch in batches:
                for *key, piece in zip(*(column.to_pylist() for column in batch.columns)):
                    if out is None or key != owner:
                        close()
                        folder = os.path.join(root, *map(_folder, keys, key))
                        os.makedirs(folder, exist_ok=True)
                        owner, aside = key, os.path.join(folder, f".{uuid.uuid4().hex}")
                        name = f"part-{''.join(str(int(k is None)) for k in key)}.txt"  # a null and an empty key share their folder
                        out = open(aside, "wb")
                    out.write((piece or "").encode() + end)
                yield pa.RecordBatch.from_pydict({"pieces": [len(batch)]})
            close()
            out = None
        finally:
            if out is not None and not out.closed:
                out.close()
                os.remove(aside)

    texts = laid.select(*[F.col(k).cast("string").alias(k) for k in keys], "piece")
    texts.mapInArrow(run, "pieces long").agg(F.sum("pieces")).collect()
    files.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")).close()


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))


def transcript_payloads(segments: DataFrame, part_rows: int = BLOCK_ROWS) -> DataFrame:
    """``video_id, first_idx, segments``: the ordered segment array, in parts for enormous videos."""
    item = F.struct(F.col("seg_idx").alias("_o"), F.struct("text", "start", "duration").alias("s"))
    parts = segments.withColumn("_part", block_of("seg_idx", part_rows)).groupBy("video_id", "_part").agg(
        F.sort_array(F.collect_list(item)).alias("_items"), F.min("seg_idx").alias("first_idx")
    )
    return parts.select("video_id", "first_idx", F.transform("_items", lambda x: x["s"]).alias("segments"))


def write_transcripts(segments: DataFrame, path: str) -> None:
    """JSON lines, one ordered array per video (or part)."""
    with_bucket(transcript_payloads(segments)).write.mode("overwrite").partitionBy("bucket").json(path)


def upsert_by_video(
    new: DataFrame, path: str, buckets: int = BUCKETS, replaced: DataFrame | None = None, order: tuple[str, ...] = ()
) -> None:
    """Replace all rows of the videos in ``new`` and in ``replaced``; other videos and untouched buckets stay.
    ``order`` sorts the rows of a bucket, so that readers can skip by these columns.

    A video in ``replaced`` alone keeps no row: its text became empty.

    The merged buckets are written aside first, then swapped in by dynamic partition overwrite, whose
    committer replaces a partition only when the job succeeds. What was written aside goes after that.
    """
    with passing_tables(new.sparkSession), shuffles_freed(new.sparkSession):
        _upsert(new, path, buckets, replaced, order)


def _upsert(new: DataFrame, path: str, buckets: int, replaced: DataFrame | None, order: tuple[str, ...]) -> None:
    spark = new.sparkSession
    if not order and not _exists(spark, path):  # nothing to merge with: the rows are read once, so they need no copy
        with_bucket(new, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return
    staged = written_once(with_bucket(new, buckets), "upsert")  # computed once: ids and rows are read from it
    ids = staged.select("video_id", "bucket")
    if replaced is not None:
        ids = ids.unionByName(with_bucket(replaced.select("video_id"), buckets))
    ids = ids.distinct()
    touched = None
    if _exists(spark, path):
        old = spark.read.parquet(path)
        touched = ids.select("bucket").distinct()  # at most `buckets` rows
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(ids.select("video_id"), "video_id", "left_anti")
        staged = written_once(kept, "upsert-kept").unionByName(staged, allowMissingColumns=True)
    emptied = [] if touched is None else touched.join(staged.select("bucket").distinct(), "bucket", "left_anti").collect()
    if order:
        staged = staged.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for row in emptied:  # a bucket without any row left is not overwritten by the writer
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row.bucket}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_videos(ids: DataFrame, paths: list[str], buckets: int = BUCKETS) -> None:
    """Delete every row of the videos ``ids`` from each stored table; only their buckets are rewritten."""
    spark = ids.sparkSession
    ids = written_once(ids.select("video_id").distinct(), "deleted")
    for path in paths:
        if _exists(spark, path):
            nothing = spark.read.parquet(path).drop("bucket").limit(0)
            upsert_by_video(nothing, path, buckets, replaced=ids)


def _exists(spark: SparkSession, path: str) -> bool:
    """True when a table is stored at ``path``; a folder without any file or bucket, left by an empty write, has no schema."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(target) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(target))


def write_segments(segments: DataFrame, path: str) -> None:
    """Replace enriched segments (or merged groups) of the given videos."""
    upsert_by_video(segments, path)


def write_chunks(chunks: DataFrame, path: str, replaced: DataFrame | None = None) -> None:
    """Replace the chunks of the given videos, and drop those of the other videos in ``replaced``."""
    upsert_by_video(chunks, path, replaced=replaced)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Summary cache, keyed by video only: the newest row per video replaces the stored one."""
    newest = summaries.groupBy("video_id").agg(F.max_by(F.struct(*summaries.columns), "created_at").alias("r"))
    upsert_by_video(newest.select("r.*"), path)


def run_log_text(runs: DataFrame) -> DataFrame:
    """Run-log columns as the texts that are stored (``NaN`` for missing, three decimals)."""
    kinds = {"double": "float", "float": "float", "int": "int", "bigint": "int"}
    types = {f.name: f.dataType.simpleString() for f in runs.schema}
    return runs.select(
        *[
            (num.log_cell(F.col(c), kinds.get(types[c], "text")) if c in types else F.lit(fv.NAN)).alias(c)
            for c in fv.RUN_LOG_COLUMNS
        ]
    )


def write_run_log(runs: DataFrame, path: str) -> None:
    run_log_text(runs).write.mode("overwrite").csv(path, header=True, escape='"')
