"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import WORD, packed, whole_text
from cuewright.session import passing_tables, written_once

#: Fractional part of the golden ratio: its multiples are the schedule's points.
GOLDEN = 0.6180339887498949
#: Hash buckets that order a source's documents; a window never holds more than one bucket of one source.
SHUFFLE_BUCKETS = 4096
#: Schedule slots ranked in one window.
SLOTS_PER_CHUNK = 65536


def sizes_of(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words, and the position of the document in its source's shuffled order."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumn(
        "shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words. With caps sorted
    by cap / weight, the sources that stop at their cap are a prefix, so the repeated resharing has a closed form:
    the first row whose cap is above its weight's part of what is left ends the prefix.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    limit = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("spent", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap)))
    per = per.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.col("total") - F.col("spent")) / F.col("open_weight")
    per = per.withColumn("level", level).withColumn("free", limit > F.col("level") * F.col("weight"))
    # The water level is that of the first source that does not stop.
    per = per.withColumn("place", F.row_number().over(by_ratio))
    per = per.withColumn("final", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), limit).otherwise(F.least(limit, F.col("final") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def placed_documents(sizes: DataFrame) -> DataFrame:
    """Add ``start``: words before the document in its source's shuffled order.

    Prefix sums in two levels, over hash buckets and inside them, so a source with a third of all rows is spread out.
    """
    bucket = (F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int")).alias("bucket")
    rows = sizes.select("*", bucket)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("t_source"), F.col("bucket").alias("t_bucket"), F.coalesce(F.sum("in_bucket").over(across), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        totals, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("bucket") == F.col("t_bucket"))
    )
    return joined.withColumn("start", F.col("before") + F.col("offset")).drop("bucket", "offset", "before", "t_source", "t_bucket", "shuffle")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """slot, source, rank, words: the order in which blocks of the sources are read.

    Point ``slot * golden ratio mod 1`` falls into a source's interval of the cumulative targets; a source's slots
    are ranked, and rank r reads its block r. A source needs ``ceil(target / block)`` slots, the last one partial:
    surplus slots are left out, and what the points missed of a source (a few slots) follows at the end.
    """
    spark = targets.sparkSession
    need = targets.withColumn("take", F.floor(F.col("target") + F.lit(0.5)).cast("long")).where("take > 0")
    need = need.withColumn("slots", F.ceil(F.col("take") / F.lit(block)).cast("long"))
    total, n = need.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells = 1 << max(10, (2 * n).bit_length())
    upto = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, 0)
    need = need.withColumn("hi", F.sum("slots").over(upto) / F.lit(float(max(total, 1))))
    need = need.withColumn("lo", F.col("hi") - F.col("slots") / F.lit(float(max(total, 1))))
    first, last = F.floor(F.greatest(F.col("lo"), F.lit(0.0)) * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    by_cell = need.withColumn("cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    points = spark.range(total).withColumn("u", F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN)))
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    hit = points.join(by_cell, "cell").where("u >= lo and u < hi").select("id", "source", "take", "slots")
    hit = hit.withColumn("chunk", F.floor(F.col("id") / SLOTS_PER_CHUNK))
    counts = hit.groupBy("source", "chunk").count()
    across = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"), F.coalesce(F.sum("count").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "chunk").orderBy("id")
    ranked = hit.withColumn("in_chunk", F.row_number().over(inside) - 1).join(
        counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk"))
    )
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_chunk")).where("rank < slots")
    got = hit.groupBy("source").agg(F.count("*").alias("got"))
    got = need.join(got.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")), "left")
    late = got.withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = late.withColumn("rank", F.explode(F.sequence(F.col("got").cast("long"), F.col("slots") - 1)))
    late = late.select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank", "take")
    slots = ranked.select(F.col("id").alias("slot"), "source", "rank", "take").unionByName(late)
    return slots.select("slot", "source", "rank", F.least(F.lit(block), F.col("take") - F.col("rank") * block).cast("long").alias("words"))


def _overlap(lo: Column, hi: Column, upto: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, upto) - lo)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 1024, seed: int = 1, name: str = "mix"
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, start: one row per document.

    Documents of a source are shuffled by a hash of their id and cut into blocks of ``block`` words; a second turn
    through a source reads its blocks again. ``cap`` is a whole number of turns. Each source's taken words equal its
    target rounded to a whole word, all but the two documents at the end of the last turn are taken whole.
    Null and empty texts have size 0 and are taken 0 times; a null source is a source. Repeated rows are documents
    of their own. Empty input gives no rows.
    """
    turns = int(cap)
    sizes = written_once(sizes_of(docs, seed), f"{name}-sizes")
    targets = written_once(source_targets(sizes, weights, share, cap), f"{name}-targets")
    placed = placed_documents(sizes)
    # Turn t reads the blocks of its own words [t * source_size, (t + 1) * source_size).
    pieces = placed.where("size > 0").join(
        targets.select(F.col("source").alias("p_source"), "source_size"), F.col("source").eqNullSafe(F.col("p_source"))
    )
    pieces = pieces.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in range(turns)])))
    pieces = pieces.withColumn("lo", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("hi", F.col("lo") + F.col("size"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block).cast("long"), F.floor((F.col("hi") - 1) / block).cast("long"))))
    slots = schedule(targets, block).select(F.col("source").alias("s_source"), F.col("rank").alias("s_rank"), "words")
    read = pieces.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rank") == F.col("s_rank")), "left")
    base = F.col("rank") * block
    words = _overlap(F.greatest(F.col("lo"), base), F.col("hi"), base + F.coalesce(F.col("words"), F.lit(0)))
    taken = read.groupBy("doc_id", "source", "size", "start").agg(F.sum(words).cast("long").alias("taken"))
    empty = placed.where("size = 0").select("doc_id", "source", "size", "start", F.lit(0).cast("long").alias("taken"))
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    out = taken.unionByName(empty).join(named, F.col("source").eqNullSafe(F.col("t_source")))
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", "start")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as its words were taken (rounded to whole documents).

    A document with taken 0 goes; a document of size 0 is never read and goes too. Row order is free; all columns stay.
    Rows that repeat an id are told apart by their size, and equal ones take the mean of what they were taken.
    """
    with passing_tables(docs.sparkSession) as keep:
        taken = mix(docs, **options).groupBy("doc_id", "size").agg((F.sum("taken") / F.count("*")).alias("m_taken"))
        taken = taken.select(F.col("doc_id").alias("m_id"), F.col("size").alias("m_size"), "m_taken")
        # Written, so that the schedule's shuffles do not lie beside that of the texts.
        taken = keep(written_once(taken, "mix-taken"))
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    rows = docs.select(packed(docs).alias("m_row"), F.col("doc_id").alias("m_doc"), size.alias("m_words"))
    joined = rows.join(taken, F.col("m_doc").eqNullSafe(F.col("m_id")) & (F.col("m_words") == F.col("m_size")))
    times = F.floor(F.col("m_taken") / F.greatest("m_words", F.lit(1)) + 0.5).cast("int")
    joined = joined.where("m_words > 0").withColumn("m_times", times).where("m_times > 0")
    return joined.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times")))).select("m_row.*")
