"""Column helpers and ordered helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.session import written_once

#: ASCII white space, and a word as a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written_once`` in at most three files per core of the cluster, for tables much smaller than what they come from."""
    return written_once(df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism), name)


#: Rows of an Arrow batch that are worked on at a time where a row becomes much larger than its text.
SLICE_ROWS = 1000


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE_ROWS) -> Iterator[pd.DataFrame]:
    """The batches in pieces of at most ``rows`` rows, so that what is made of a batch does not all lie in memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so an operator's helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII strings take the built-in fast path."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def order_buckets(df: DataFrame, order: str, rows_per_bucket: int) -> list:
    """Cut points of ``order`` that split ``df`` into buckets of about ``rows_per_bucket`` rows.

    One scan of one column; the number of cut points is at most 4 096, so it is a bounded driver value and
    buckets grow with the data beyond that.
    """
    rows = df.count()
    n = min(4096, rows // rows_per_bucket)
    if n < 1:
        return []
    cuts = df.stat.approxQuantile(order, [i / (n + 1) for i in range(1, n + 1)], 1 / (4 * (n + 1)))
    return sorted(set(cuts))


def with_next(df: DataFrame, order: str, ties: list[str], carried: list[str], rows_per_bucket: int = 4096) -> DataFrame:
    """Add ``next_<c>`` for each carried column: the value in the next row by (``order``, ``ties``), the last row wrapping to the first.

    Rows are dealt to ordered buckets with one shuffle. The first row of every bucket is also sent to the bucket
    before it, so no window sees more than a bucket. Null ``order`` values come last, in a bucket of their own.
    A single row is its own successor. ``row_place`` numbers the rows, with gaps, in that order.
    """
    cuts = order_buckets(df, order, rows_per_bucket)
    if cuts:
        bounds = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(bounds, lambda b: b <= F.col(order).cast("double")))
    else:
        bucket = F.lit(0)
    n_null = len(cuts) + 1
    placed = df.withColumn("_bucket", F.when(F.col(order).isNull(), F.lit(n_null)).otherwise(bucket).cast("int"))
    sort_key = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    placed = placed.withColumn("_key", sort_key)
    # The first row of each bucket: one row per bucket, kept without its long columns until the join by key.
    firsts = placed.groupBy("_bucket").agg(F.min("_key").alias("_first"))
    ring = firsts.withColumn(
        "_to",
        F.coalesce(
            F.lag("_bucket").over(Window.orderBy("_bucket")),
            F.max("_bucket").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ),
    ).select("_bucket", "_first", "_to")
    marked = placed.join(F.broadcast(ring), "_bucket")  # one row per bucket: at most 4 098
    halo = F.when(F.col("_key") == F.col("_first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = marked.withColumn("_halo", F.explode(halo))
    dealt = dealt.withColumn("_bucket", F.when(F.col("_halo"), F.col("_to")).otherwise(F.col("_bucket")))
    inside = Window.partitionBy("_bucket").orderBy("_halo", "_key")
    place = F.col("_bucket").cast("long") * F.lit(1 << 40) + F.row_number().over(inside)
    out = dealt.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried], place.alias("row_place"))
    return out.where(~F.col("_halo")).drop("_bucket", "_key", "_first", "_to", "_halo")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``row_number``: 0, 1, 2, ... by the columns ``order`` (ascending, null first), written once.

    One range sort; rows that tie are dealt on by where they were read, so a key with a third of all rows spreads over
    tasks. Their numbers are arbitrary among them, so ``order`` must tell apart all rows that are not interchangeable, and ``df`` must be
    read from files (or be otherwise repeatable). Only one row per task of that sort is summed up and broadcast.
    """
    spread = df.withColumn("_read", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "_read").sortWithinPartitions(*order, "_read").drop("_read")
    placed = written_once(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    task, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return out.withColumn("row_number", F.col("_start") + inside).drop("_at", "_task", "_start")
