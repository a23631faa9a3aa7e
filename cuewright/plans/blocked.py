"""Ordered operators that never need one task per video.

A window partitioned by ``video_id`` alone sends a whole video to one task, and one video may hold
a third of all rows. Everything ordered here works on *blocks*: ``(keys, block)`` where the block
number is a monotone function of the order column, so a hot video spreads over many tasks.

* ``with_halo`` copies the few rows next to a block edge into the neighbour block, after which
  ``lag`` / ``lead`` / bounded row frames inside one block are exact.
* ``running`` is a prefix scan. When no key leaves its first block it is one plain window. Else it
  has two levels: windows inside blocks, partial aggregates per block, a window over the block
  totals (one row per block), and one equi join back.

Which form is needed is a checked size: ``many_blocks`` reads the largest index position, a scan
without a shuffle that prunes to the position column. In the two-level form the input is written
once to the shared folder, so chained scans do not recompute each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.session import written_once

# Index positions per block. 65 536 rows fit a task easily; a video of 10^10 rows still has only
# about 150 000 block totals for the upper window.
BLOCK_ROWS = 1 << 16


def block_of(position: Column | str, size: int = BLOCK_ROWS) -> Column:
    """Block number of an index position."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("long")


def many_blocks(df: DataFrame, position: Column | str, size: int = BLOCK_ROWS) -> bool:
    """True when some key reaches past its first block."""
    position = F.col(position) if isinstance(position, str) else position
    largest = df.select(F.max(position).alias("m")).first()["m"]
    return largest is not None and largest >= size


def with_halo(
    df: DataFrame,
    idx: str,
    before: int = 0,
    after: int = 0,
    size: int = BLOCK_ROWS,
    many: bool | None = None,
    keys: Sequence[str] = ("video_id",),
    dense: bool = False,
) -> DataFrame:
    """Add ``_blk`` / ``_core``; edge rows also appear (``_core`` false) in the neighbour block.

    ``before`` / ``after`` are the rows of context needed to the left and to the right and must not
    exceed the block size. Neighbours are the rows next in order, whatever indexes are missing between
    them: rows are numbered first, unless ``dense`` says that ``idx`` already counts 0, 1, 2, ... per key.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a block")
    if many is None:
        many = many_blocks(df, idx, size)
    if not many:
        return df.withColumns({"_blk": F.lit(0).cast("long"), "_core": F.lit(True)})
    place = F.col(idx)
    if not dense:
        df = dense_position(df, keys, [idx], block_of(idx, size), "_place", True)
        place = F.col("_place")
    home, offset = block_of(place, size), place % F.lit(size)
    copies = [F.struct(home.alias("blk"), F.lit(True).alias("core"))]
    if before:
        copies.append(
            F.when(offset >= size - before, F.struct((home + 1).alias("blk"), F.lit(False).alias("core")))
        )
    if after:
        copies.append(
            F.when(
                (offset < after) & (home > 0),
                F.struct((home - 1).alias("blk"), F.lit(False).alias("core")),
            )
        )
    exploded = df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    return exploded.withColumns({"_blk": F.col("_copy.blk"), "_core": F.col("_copy.core")}).drop("_copy", "_place")


def block_window(keys: Sequence[str], *order: Column | str, many: bool):
    """Window over one block; use with rows prepared by ``with_halo``.

    Keys that fit one block are partitioned by the key alone, so chained operators share one shuffle
    and one sort.
    """
    return Window.partitionBy(*keys, *(["_blk"] if many else [])).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_core")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    many: bool | None = None,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (last non-null) per key over ``order``.

    ``df`` must carry ``_blk``, monotone in ``order``; with ``many`` false it is 0 for every row.
    ``specs`` maps an output name to ``(kind, expression)``. ``reverse`` scans from the end, so an
    exclusive ``last`` then means "next non-null value".
    """
    if many is None:
        many = many_blocks(df, "_blk", 1)
    part = [*keys, "_blk"] if many else list(keys)
    frame_end = 0 if inclusive else -1
    row_order = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    block_order = F.col("_blk").desc() if reverse else F.col("_blk").asc()
    local = Window.partitionBy(*part).orderBy(*row_order).rowsBetween(
        Window.unboundedPreceding, frame_end
    )
    over = {
        "sum": lambda e: F.coalesce(F.sum(e).over(local), F.lit(0)),
        "max": lambda e: F.max(e).over(local),
        "last": lambda e: F.last(e, ignorenulls=True).over(local),
    }
    if not many:
        return df.withColumns({n: over[kind](e) for n, (kind, e) in specs.items()})

    df = written_once(df, "running")
    above = Window.partitionBy(*keys).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)

    rows = df.withColumns({f"_in_{n}": e for n, (_, e) in specs.items()})
    pick = F.min_by if reverse else F.max_by
    totals_agg, carry_cols, local_cols, out = [], [], {}, {}
    for name, (kind, _) in specs.items():
        value = F.col(f"_in_{name}")
        total, carry, here = F.col(f"_t_{name}"), F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            totals_agg.append(F.sum(value).alias(f"_t_{name}"))
            carry_cols.append(F.sum(total).over(above).alias(f"_c_{name}"))
            local_cols[f"_l_{name}"] = F.sum(value).over(local)
            zero = F.lit(0)
            out[name] = F.coalesce(carry, zero) + F.coalesce(here, zero)
        elif kind == "max":
            totals_agg.append(F.max(value).alias(f"_t_{name}"))
            carry_cols.append(F.max(total).over(above).alias(f"_c_{name}"))
            local_cols[f"_l_{name}"] = F.max(value).over(local)
            out[name] = F.greatest(carry, here)
        elif kind == "last":
            totals_agg.append(pick(value, F.when(value.isNotNull(), rank)).alias(f"_t_{name}"))
            carry_cols.append(F.last(total, ignorenulls=True).over(above).alias(f"_c_{name}"))
            local_cols[f"_l_{name}"] = F.last(value, ignorenulls=True).over(local)
            out[name] = F.coalesce(here, carry)
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    carried = rows.groupBy(*part).agg(*totals_agg).select(*part, *carry_cols)
    scanned = rows.withColumns(local_cols).join(carried, part)
    helper = [f"_{p}_{n}" for n in specs for p in ("in", "l", "c")]
    return scanned.withColumns(out).drop(*helper)


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str = "pos",
    many: bool | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, ... per key without one task per key; ``block`` is monotone in ``order``."""
    one = {name: ("sum", F.lit(1).cast("long"))}
    numbered = running(df.withColumn("_blk", block), keys, order, one, inclusive=False, many=many)
    return numbered.drop("_blk")


def value_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, *, descending: bool = False, name: str = "rank"
) -> DataFrame:
    """0-based rank by ``value`` per key, ties by the index ``tie``, without a window over a whole key.

    The rows with a smaller value are counted from one row per distinct value; equal values are
    numbered in blocks of ``tie``. Suits values with few distinct levels, such as milliseconds.
    """
    keys = list(keys)
    order = F.col(value).desc() if descending else F.col(value).asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        df.groupBy(*keys, value)
        .agg(F.count("*").alias("_same"))
        .select(*keys, value, F.coalesce(F.sum("_same").over(before), F.lit(0)).alias("_ahead"))
    )
    many = many_blocks(df, tie)
    placed = dense_position(df, [*keys, value], [tie], block_of(tie), "_tie", many)
    return placed.join(levels, [*keys, value]).withColumn(name, F.col("_ahead") + F.col("_tie")).drop("_ahead", "_tie")


def with_offsets(df: DataFrame, keys: Sequence[str], order: str, length: Column, name: str = "offset") -> DataFrame:
    """Add where each row starts when the rows of a key are laid end to end in order, given their lengths."""
    spec = {name: ("sum", length.cast("long"))}
    return running(df.withColumn("_blk", block_of(order)), keys, [order], spec, inclusive=False).drop("_blk")


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    separator: str,
    *,
    part_rows: int = BLOCK_ROWS,
    name: str = "text",
) -> DataFrame:
    """Join ``text`` in order, one row per ``(keys, part)``.

    A part covers ``part_rows`` index positions, so no value or task grows with a video; joining the
    parts in order with ``separator`` gives the whole text. Most videos have exactly one part.
    """
    parts = df.withColumn("part", block_of(order, part_rows)).where(F.col(text).isNotNull())
    gathered = parts.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_all")
    )
    return gathered.select(
        *keys, "part", F.array_join(F.transform("_all", lambda x: x["t"]), separator).alias(name)
    )
