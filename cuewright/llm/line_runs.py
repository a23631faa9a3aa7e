"""Line dedup by levelled sorted runs of line hashes that are compacted as they pile up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import SPACE_CHARS, ascii_lower, packed, whole_text
from cuewright.session import scratch_path, written_once

#: A null doc_id counts as one document below all others.
NO_ID = -(1 << 63)


def lines_of(name: str = "text") -> Column:
    return F.split(whole_text(name), "\n", -1)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """line (128-bit hash of the key in hex), doc_id, same (hash of the text), place: every long line. A-Z need lower-casing in long lines alone."""
    trimmed = F.transform(lines_of(), lambda line, i: F.struct(F.trim(line, F.lit(SPACE_CHARS)).alias("key"), i.alias("place")))
    long = F.filter(trimmed, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.md5(ascii_lower(x["key"])).alias("line"), x["place"].alias("place")))
    return docs.select(_id().alias("doc_id"), F.xxhash64(whole_text()).alias("same"), F.explode(hashed).alias("x")).select("doc_id", "same", "x.line", "x.place")


class LineRuns:
    """Sorted runs (line, n_docs, keeper) in levels of the shared folder.

    A batch adds one run to level 0. When a level holds ``fanout`` runs, they are merged into one run of the next
    level, so a line's counts are rewritten once per level and a lookup reads at most ``fanout`` runs per level.
    Batches must not share documents; runs add up counts and keep the largest document.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        rows.sortWithinPartitions("line").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("line string, n_docs long, keeper long").parquet(*paths)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Add the occurrences (line, doc_id) of new documents as a sorted run, then compact full levels."""
        once = batch.groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
        run = once.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self._read(self.levels[level])))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def rows(self) -> DataFrame:
        """One row per line over all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "line string, n_docs long, keeper long")
        return self._merged(self._read(paths)) if len(paths) > 1 else self._read(paths)

    def _frequent(self, min_docs: int) -> DataFrame:
        return self.rows().where(F.col("n_docs") >= min_docs).select(F.col("line").alias("r_line"), "keeper")

    def survivors(self, batch: DataFrame, min_docs: int) -> DataFrame:
        """Merge-anti-join: the occurrences that stay, all but those of a line in ``min_docs`` documents outside its keeper."""
        match = (F.col("line") == F.col("r_line")) & (F.col("doc_id") < F.col("keeper"))
        return batch.join(self._frequent(min_docs), match, "left_anti")

    def dropped(self, batch: DataFrame, min_docs: int) -> DataFrame:
        """What the anti-join leaves out; it is the smaller part of a corpus."""
        match = (F.col("line") == F.col("r_line")) & (F.col("doc_id") < F.col("keeper"))
        return batch.join(self._frequent(min_docs), match, "left_semi")


def _holds(lists: Column, place: Column) -> Column:
    """Whether ``place`` is in places dealt to lists by remainder: a lookup reads about the root of their number."""
    return F.array_contains(F.get(lists, place % F.size(lists)), place)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """All columns of ``docs`` and ``ld_lines``, ``ld_dropped``, ``ld_text``: its lines, those dropped, the text that stays.

    Lines whose key (white space stripped, A-Z lower-cased) has ``min_chars`` code points and is found in ``min_docs``
    documents go from all documents but the one with the largest doc_id. Null and empty texts are one empty line.
    A null doc_id is one document below all others. Rows that share a doc_id count as one document; each loses the
    places at which its own text holds such a line.
    """
    spark = docs.sparkSession
    rows = docs.select(packed(docs).alias("row"), whole_text().alias("text"), _id().alias("ld_key"), F.xxhash64(whole_text()).alias("ld_same"))
    found = occurrences(docs, min_chars)
    found = found.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    stored = written_once(found, "line-occurrences")
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(stored.where(F.col("batch") == batch).select("line", "doc_id"))
    gone = runs.dropped(stored.select("line", "doc_id", "same", "place"), min_docs)
    gone = gone.groupBy("doc_id", "same").agg(F.collect_set("place").alias("ld_gone"))
    n = F.ceil(F.sqrt(F.size("ld_gone"))).cast("int")
    lists = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(F.col("ld_gone"), lambda p: p % n == b))
    gone = gone.select(F.col("doc_id").alias("ld_id"), F.col("same").alias("ld_text_id"), F.size("ld_gone").alias("ld_n"), lists.alias("ld_lists"))
    joined = rows.join(gone, (F.col("ld_key") == F.col("ld_id")) & (F.col("ld_same") == F.col("ld_text_id")), "left")
    kept = F.filter(lines_of(), lambda line, i: ~_holds(F.col("ld_lists"), i))
    return joined.select(
        "row.*",
        F.size(lines_of()).cast("long").alias("ld_lines"),
        F.coalesce("ld_n", F.lit(0)).cast("long").alias("ld_dropped"),
        F.when(F.col("ld_n").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("ld_text"),
    )
