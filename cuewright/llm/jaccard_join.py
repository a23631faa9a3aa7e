"""Exact n-gram Jaccard join: regions around pivots, links and partners by the triangle inequality, recursion in what is left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import SLICE_ROWS, packed, slices, stored
from cuewright.llm.components import components
from cuewright.llm.shingles import STEP, WordHashes, mixed, shingle_set
from cuewright.plans.sizes import broadcast_if_small, hinted
from cuewright.session import discard, passing_tables, written_once

#: Most ids that a broadcast may hold (8 bytes each), and most bytes of pivot sets.
MAX_BROADCAST, PIVOT_BYTES = 1_000_000, 32_000_000
#: Cells that one task counts, about, and bits of the map of shared cells at most (16 MB).
CELLS_PER_TASK, MAP_BITS = 1_000_000, 1 << 27
#: Regions of at most so many sets are compared pair by pair; a pivot is drawn from so many sets with at most so many shingles.
SMALL = 128
PIVOT_SETS, PIVOT_SHINGLES = 31, 4_000_000
#: Parts beyond those that must be kept, as a share of them: each set leaves out as many of its most common cells.
SPARE = 0.25

RING_STEP = 0xD1342543DE82EF95


def wrapped(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


class SizeRings:
    """Rings of set sizes and the parts the shingle space is cut into in each ring.

    In the metric |x delta y| the empty set is a pivot at distance |x|, so linked sets lie in the same ring or in
    neighbouring ones; a set near the upper edge of its ring is also sent to the next. In a ring, linked sets differ
    in at most ``differ`` shingles: of ``parts = differ + 1 + spare`` parts at least ``1 + spare`` are equal. In any common
    order of the cells, the first of a pair's equal cells is among the first ``differ + 1`` of both sets, for
    ``spare`` equal ones follow it. So each set needs only its ``differ + 1`` rarest cells.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.lows, self.need, self.parts = [1], [], []

    def _extend(self) -> None:
        p, low = self.percent, self.lows[-1]
        high = low * 10_000 // (p * p)  # two steps of the largest size ratio of linked sets
        differ = 2 * high * (100 - p) // (100 + p)
        self.need.append(differ + 1 if differ else 0)
        self.parts.append(differ + 1 + ceil(SPARE * (differ + 1)) if differ else 0)
        self.lows.append(high + 1)

    def of(self, n: int) -> list[int]:
        while self.lows[-1] <= n:
            self._extend()
        ring = int(np.searchsorted(self.lows, n, "right")) - 1
        if len(self.parts) <= ring + 1:
            self._extend()
        # The largest linked set has n * 100 / percent shingles.
        return [ring, ring + 1] if n * 100 >= self.lows[ring + 1] * self.percent else [ring]

    def cells(self, shingles: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """ring, cells needed, one hash per part: equal where two sets have the same shingles in it, none too."""
        found = []
        for ring in self.of(len(shingles)):
            m = self.parts[ring]
            if not m:
                continue  # linked sets of this size are equal
            h = mixed(shingles + wrapped((ring + 1) * int(STEP)))
            part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            content = np.zeros(m, np.uint64)
            content[part[starts].astype(np.int64)] = np.add.reduceat(mixed(h[order] ^ STEP), starts)
            hashes = mixed(content + np.arange(m, dtype=np.uint64) * STEP + wrapped(ring * RING_STEP))
            found.append((ring, self.need[ring], hashes.view(np.int64)))
        return found


def node_of(shingles: np.ndarray) -> int | None:
    """64-bit name of a set; equal sets have equal names, the empty set none."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())))) if len(shingles) else None


def _named(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, node of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(t, k, hashes) for t in batch["text"]]
            frame = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets]})
            frame["node"] = pd.array([node_of(s) for s in sets], dtype="Int64")
            yield frame

    return docs.mapInPandas(run, "doc_id long, n_shingles long, node long")


def _cells(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """cell, node: each set's rarest cells, as many as linked sets need to meet in one, where another set has the cell too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, rings = WordHashes(), SizeRings(percent)
        for batch in slices(batches):
            sets = [s for s in (shingle_set(t, k, hashes) for t in batch["text"]) if len(s)]
            rows = [(node_of(s), ring, need, cells) for s in sets for ring, need, cells in rings.cells(s)]
            yield pd.DataFrame(rows, columns=["node", "ring", "need", "cells"])

    dealt = written_once(docs.select("text").mapInPandas(run, "node long, ring int, need int, cells array<long>"), "jaccard-parts")
    shared = written_once(_shared(dealt), "jaccard-shared")
    # Dealt by node alone, the three steps that follow shuffle nothing more.
    rows = _candidates(dealt, shared).join(shared, "cell").repartition("node").dropDuplicates(["node", "ring", "cell"])
    mine = Window.partitionBy("node", "ring")
    rank, common = F.row_number().over(mine.orderBy("f", "cell")), F.count("*").over(mine)
    kept = rows.withColumns({"rank": rank, "common": common})  # the cells that nobody shares come first
    cells = stored(kept.where("rank <= over + common").select("cell", "node").distinct(), "jaccard-cells")
    discard(dealt, shared)
    return cells


def _shared(dealt: DataFrame) -> DataFrame:
    """cell, f: the cells that occur more than once and how often.

    Cells travel packed, counted once per batch, in as many buckets of their hash as the data need for CELLS_PER_TASK cells each.
    """
    total = dealt.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
    buckets = total // CELLS_PER_TASK + 1
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 2 * SLICE_ROWS):
            if len(batch):
                values, counts = np.unique(np.concatenate(batch["cells"].to_list()).view(np.uint64), return_counts=True)
                cut = np.r_[0, np.searchsorted(values, edges), len(values)]
                some = np.flatnonzero(np.diff(cut))
                packed = [(b, values[cut[b] : cut[b + 1]].tobytes(), counts[cut[b] : cut[b + 1]].astype(np.uint32).tobytes()) for b in some]
                yield pd.DataFrame(packed, columns=["bucket", "cells", "counts"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.concatenate([np.frombuffer(b, np.uint64) for b in group["cells"]])
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in group["counts"]])
        values, at = np.unique(cells, return_inverse=True)
        f = np.bincount(at, counts, len(values)).astype(np.int64)
        return pd.DataFrame({"cell": values[f > 1].view(np.int64), "f": f[f > 1]})

    packed = dealt.select("cells").mapInPandas(pack, "bucket long, cells binary, counts binary")
    return packed.groupBy("bucket").applyInPandas(count, "cell long, f long")


def _candidates(dealt: DataFrame, shared: DataFrame) -> DataFrame:
    """cell, node, ring, over (needed cells less all cells): the cells that may be shared, by a bit map of bounded size.

    The map has 16 bits for each shared cell, up to MAP_BITS; beyond that more cells pass, which the join that follows sorts out.
    """
    bits = 1 << min(max((16 * shared.count()).bit_length(), 16), MAP_BITS.bit_length() - 1)
    at = F.col("cell").bitwiseAND(F.lit(bits - 1)) + 1
    maps = shared.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    seen = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():  # at most MAP_BITS bits
        piece = np.frombuffer(row["map"], np.uint8)[: bits // 8]
        seen[(row["part"] - 1) * 4096 : (row["part"] - 1) * 4096 + len(piece)] = piece

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sizes = batch["cells"].map(len).to_numpy()
            cells = np.concatenate([*batch["cells"], np.empty(0, np.int64)]).astype(np.int64)
            place = cells & (bits - 1)
            hit = np.flatnonzero((seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(batch)), sizes)[hit]
            over = batch["need"].to_numpy() - sizes
            yield pd.DataFrame({"cell": cells[hit], "node": batch["node"].to_numpy()[row], "ring": batch["ring"].to_numpy()[row], "over": over[row]})

    return dealt.mapInPandas(run, "cell long, node long, ring int, over int")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [s for s in (shingle_set(t, k, hashes) for t in batch["text"]) if len(s)]
            yield pd.DataFrame({"node": np.array([node_of(s) for s in sets], np.int64), "shingles": [s.tobytes() for s in sets]})

    return docs.select("text").mapInPandas(run, "node long, shingles binary").dropDuplicates(["node"])


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint where the number of ids was checked; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _regions(cells: DataFrame) -> DataFrame:
    """Cells that have the same smallest member become one region: a group of near copies fills few regions, not one per part."""
    least = cells.groupBy("cell").agg(F.min("node").alias("region"), F.max("node").alias("most")).where("region <> most")
    return cells.join(least, "cell").select(F.col("region").alias("cell"), "node").distinct()


def _direct(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links within regions of at most SMALL sets, read one after the other.

    Sets that are in one component already (``component``, or by links found on the way) are not compared.
    """

    def links(group: list[tuple[int, np.ndarray, int]]) -> Iterator[tuple[int, int]]:
        label = [component for _, _, component in group]
        for i, j in combinations(range(len(group)), 2):
            if label[i] == label[j]:
                continue
            (a, x, _), (b, y, _) = group[i], group[j]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                old, new = label[j], label[i]
                label = [new if c == old else c for c in label]
                yield a, b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group = None, []
        for batch in batches:
            out = []
            for cell, node, component, shingles in zip(batch["cell"], batch["node"], batch["component"], batch["shingles"]):
                if cell != at:
                    out += links(group)
                    at, group = cell, []
                group.append((node, np.frombuffer(shingles, np.uint64), component))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(list(links(group)), columns=["a", "b"], dtype=np.int64)

    rows = cells.join(sets, "node").select("cell", "node", "component", "shingles").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInPandas(run, "a long, b long")


def _pivots(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """cell, pivot: the shingles that more than half of some of a region's sets hold.

    A pivot need not be a document. This one lies in the middle, so few sets differ from it in the same shingle.
    """
    first = Window.partitionBy("cell").orderBy("node")
    some = cells.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOT_SETS).join(sets, "node")
    so_far = F.sum(F.octet_length("shingles") / 8).over(Window.partitionBy("cell").orderBy("place"))
    some = some.withColumn("so_far", so_far).where((F.col("place") == 1) | (F.col("so_far") <= PIVOT_SHINGLES))

    def majority(group: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in group["shingles"]]), return_counts=True)
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "pivot": [values[2 * counts > len(group)].tobytes()]})

    return some.select("cell", "shingles").groupBy("cell").applyInPandas(majority, "cell long, pivot binary")


def _differences(cells: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cell, node, most, slack, apart: in how many shingles a set linked with this one may differ from it, how far it is from its
    region's pivot beyond its own half of a link, and the shingles in which it differs from the pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for cell, node, pivot, shingles in zip(batch["cell"], batch["node"], batch["pivot"], batch["shingles"]):
                x = np.frombuffer(shingles, np.uint64)
                apart = np.setxor1d(x, np.frombuffer(pivot, np.uint64), assume_unique=True)
                n = len(x)
                rows.append((cell, node, (100 - percent) * n // percent, (100 + percent) * len(apart) - (100 - percent) * n, apart.view(np.int64)))
            yield pd.DataFrame(rows, columns=["cell", "node", "most", "slack", "apart"])

    size = pivots.agg(F.coalesce(F.sum(F.octet_length("pivot")), F.lit(0))).first()[0]
    rows = cells.join(sets, "node").join(hinted(pivots, size <= PIVOT_BYTES), "cell").select("cell", "node", "pivot", "shingles")
    return rows.mapInPandas(run, "cell long, node long, most long, slack long, apart array<long>")


def _around(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One step in large regions: (links a, b; what ``_parts`` needs: cell, node, most, apart, middle).

    With X the difference of set x from the pivot, |x delta y| <= |X| + |Y|: two sets whose slacks add up to at most 0 are linked, untested.
    So all whose slack the region's least slack makes up for are linked with the set of least slack, the ``middle``. Every other set x is
    too far for that with any y, so if it is linked with y, X and Y share a shingle.
    """
    pivots = written_once(_pivots(cells, sets), "jaccard-pivots")
    rows = written_once(_differences(cells, pivots, sets, percent), "jaccard-differences")
    near = rows.groupBy(F.col("cell").alias("n_cell")).agg(F.min(F.struct("slack", "node")).alias("best"), F.max("slack").alias("worst"))
    near = broadcast_if_small(stored(near.select("n_cell", F.col("best.slack").alias("least"), F.col("best.node").alias("middle"), "worst"), "jaccard-nearest"))
    rows = rows.join(near, F.col("cell") == F.col("n_cell"))
    links = rows.where((F.col("slack") + F.col("least") <= 0) & (F.col("node") != F.col("middle"))).select(F.col("middle").alias("a"), F.col("node").alias("b"))
    return links, rows.where(F.col("worst") + F.col("least") > 0).select("cell", "node", "most", "apart", "middle")


def _parts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Sub-regions (cell, node, far): sets that differ from the pivot in the same shingle, one of which is not in the middle's component.

    X and Y of linked sets differ in at most ``most`` shingles, so X has at most (most + |X| - |Y|) / 2 that Y has not, and the rarest shingle they
    share comes at the latest just behind those in X, and likewise in Y. A far set meets any set, the others need meet far ones alone, so the
    least |Y| is that of the region or of its far sets. Sub-regions shrink, as a shingle in which most sets differ from the pivot would be in the pivot.
    """
    known = stored(rows.select("cell", "node", "middle").join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-known")
    homes = known.where("node = middle").select(F.col("cell").alias("h_cell"), F.col("component").alias("home"))
    open_ = known.join(broadcast_if_small(homes), F.col("cell") == F.col("h_cell")).select(F.col("cell").alias("k_cell"), F.col("node").alias("k_node"), (F.col("component") != F.col("home")).alias("far"))
    asking = broadcast_if_small(open_.where("far").select(F.col("k_cell").alias("a_cell")).distinct())
    left = rows.join(asking, F.col("cell") == F.col("a_cell"), "left_semi").join(open_, (F.col("cell") == F.col("k_cell")) & (F.col("node") == F.col("k_node")))
    sizes = left.groupBy(F.col("cell").alias("l_cell")).agg(F.min(F.size("apart")).alias("any"), F.min(F.when(F.col("far"), F.size("apart"))).alias("away"))
    left = left.join(broadcast_if_small(sizes), F.col("cell") == F.col("l_cell"))
    partner = F.when(F.col("far"), F.col("any")).otherwise(F.col("away"))
    first = F.least(F.floor((F.col("most") + F.size("apart") - partner) / 2), F.col("most")) + 1
    each = left.select("cell", "node", first.alias("first"), "far", F.size("apart").alias("n"), F.explode("apart").alias("e"))
    shared = each.groupBy(F.col("cell").alias("s_cell"), F.col("e").alias("s_e")).agg(F.count("*").alias("f"), F.max("far").alias("asked"))
    shared = shared.where("f > 1")
    each = each.join(shared, (F.col("cell") == F.col("s_cell")) & (F.col("e") == F.col("s_e")))
    mine = Window.partitionBy("cell", "node")
    each = each.withColumns({"rank": F.row_number().over(mine.orderBy("f", "e")), "common": F.count("*").over(mine)})
    each = each.where("asked and rank <= first - n + common")
    return each.select(F.xxhash64("cell", "e").alias("cell"), "node", "far")


def _open(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions that hold a far set and more than one component; of regions with the same members one."""
    rows = cells.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = rows.groupBy(F.col("cell").alias("of_cell")).agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.max("far").alias("far"),
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    kept = sums.where("far and least <> most").groupBy("n", "x", "y").agg(F.min("of_cell").alias("of_cell"))
    return rows.join(kept.select("of_cell"), F.col("cell") == F.col("of_cell")).select("cell", "node", "component")


def linked_sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Named rows (doc_id, n_shingles, node), and id, component of the linked nodes.

    Sets meet in regions; small regions are compared directly, large ones split around their pivot, again and again.
    A shingle stays a reason to meet for at most about half of a region's sets, so the number of rounds is logarithmic
    in the largest group that is alike but not linked, and no round makes the pairs of a group.
    """
    spark = docs.sparkSession
    with passing_tables(spark) as keep:
        named = keep(written_once(_named(docs.select("doc_id", "text"), k), "jaccard-named"))
        first = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
        # Ids that only repeat sets found under a smaller id.
        roles = named.where("node is not null").join(first, "node").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("first_id")).cast("int")).alias("leads"))
        repeats = roles.where("leads = 0 and doc_id is not null").select("doc_id")
        leading = docs.select("doc_id", "text").join(_bounded(repeats), "doc_id", "left_anti")
        shared = _cells(leading, k, percent)
        cells = stored(_regions(shared).withColumn("component", F.col("node")), "jaccard-regions")
        discard(shared)
        needed = cells.select("node").distinct().join(first, "node").select(F.col("first_id").alias("doc_id")).distinct()
        at_null = docs.select("doc_id", "text").where("doc_id is null")
        wanted = leading.where("doc_id is not null").join(_bounded(needed.where("doc_id is not null")), "doc_id", "left_semi").unionByName(at_null)
        sets = written_once(_sets(wanted, k).join(cells.select("node").distinct(), "node", "left_semi"), "jaccard-sets")
        links, labels = [], spark.createDataFrame([], "id long, component long")
        while cells.limit(1).count():
            # A round leaves its links and the next regions; what it compared goes.
            with passing_tables(spark) as stay:
                before = cells
                sizes = stored(cells.groupBy(F.col("cell").alias("s_cell")).agg(F.count("*").alias("n")), "jaccard-sizes")
                sized = cells.join(sizes, F.col("cell") == F.col("s_cell")).drop("s_cell")
                links.append(stay(written_once(_direct(sized.where(F.col("n") <= SMALL).drop("n"), sets, percent), "jaccard-links")))
                if not sizes.where(F.col("n") > SMALL).limit(1).count():
                    labels = stay(components(reduce(DataFrame.unionByName, links)))
                    break
                found, rows = _around(stored(sized.where(F.col("n") > SMALL).drop("n"), "jaccard-large"), sets, percent)
                links.append(stay(stored(found, "jaccard-links")))
                labels = stay(components(reduce(DataFrame.unionByName, links)))
                cells = stay(stored(_open(stored(_parts(rows, labels), "jaccard-parts"), labels), "jaccard-regions"))
            discard(before)
        keep(labels)
    return named, labels


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, node, first_id: one row per row of ``docs``.

    Two documents are linked when 100 * |common shingles| >= percent * |all shingles| over their distinct ``k``-word
    shingles (A-Z lower-cased; fewer words are one shingle). component_id is the smallest doc_id that links lead to;
    first_id the smallest doc_id with the same set. Rows without words (null or empty text too) are linked with nothing:
    their component is their own id and node is null. Null ids take part and come out as null unless linked to others.
    Rows that share an id but not their text are different documents.
    """
    named, labels = linked_sets(docs, k, percent)
    labels = labels.select(F.col("id").alias("node"), "component")
    nodes = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(labels, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", "first_id", "component_id")
    out = named.join(nodes, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(own, "component_id").alias("component_id"), "node", F.coalesce(own, "first_id").alias("first_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document is linked to one with a smaller id, or repeats it; all columns stay.

    Rows with a null id and rows without words stay. Of rows that repeat an id and a set one stays.
    """
    with passing_tables(docs.sparkSession) as stay:
        groups = jaccard_groups(docs.select("doc_id", "text"), k, percent)
        leaders = groups.where("node is not null and doc_id = component_id").groupBy("component_id").agg(F.min("node").alias("j_node"))
        lead_id = leaders.select(F.col("component_id").alias("j_id"))
        free = groups.where("node is null").select(F.col("doc_id").alias("j_id")).where("j_id is not null").distinct()
        # Written, so that nothing of the search lies beside the texts when they are shuffled.
        keep = stay(written_once(lead_id.unionByName(free).distinct(), "jaccard-kept"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_text"))
    kept = rows.join(keep, F.col("of_id") == F.col("j_id"), "left_semi").dropDuplicates(["of_id", "of_text"])
    return kept.unionByName(rows.where("of_id is null")).select("row.*")
