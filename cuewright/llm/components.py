"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """id, component for every id that is linked to a smaller one; component is the smallest id it reaches.

    ``links`` has columns a, b in any direction; loops and repeats are ignored. Each round points every id's larger
    neighbours, then its smaller ones, at the smallest of them, and writes the links to the shared folder; a few
    rounds suffice, since paths shrink by a factor each time. Minima are taken by partial aggregation, so an id with
    many links does not become one task.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = stored(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("m_a")).agg(F.least(F.col("m_a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("m_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))
        moved = large.join(lowest, F.col("a") == F.col("m_a")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(lowest.select(F.col("m_a").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = now
