"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import stored
from cuewright.plans.sizes import broadcast_if_small
from cuewright.session import written_once

#: Vectors that the partition and the classifier are fitted on, those with the smallest hashes of their ids.
SAMPLE = 4096
#: Neighbours per vector in the sample's graph, sample vectors per partition at least, rows of one block.
DEGREE, LEAST_PART = 10, 32
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Rows that a partition should have, rows above which it is partitioned again, and rows that share one copy of a router.
PART_ROWS, LARGE_PART, PIECE_ROWS = 128, 32_768, 262_144
#: Partitions of one router at most (four fifths of a sample over LEAST_PART is fewer).
MOST_PARTS = 1 << 10


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not all zero, and holds finite numbers alone."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Symmetric 0/1 weights (sum of both directions) between the sample's nearest by inner product, as a dense bounded matrix."""
    n = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    k = min(degree, n - 1)
    graph = np.zeros((n, n), np.float32)
    if k:
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        graph[np.arange(n)[:, None], top] = 1.0
    return graph + graph.T


def halves(graph: np.ndarray, seed: int) -> np.ndarray:
    """Two equal halves of a graph with few edges between: the sign of its slowest mode, then swaps that gain."""
    n = len(graph)
    degree = graph.sum(1) + 1e-3
    scale = 1 / np.sqrt(degree)
    trivial = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
    v = np.random.default_rng(seed).normal(size=n)
    for _ in range(60):
        v -= trivial * (trivial @ v)
        v = 0.5 * (v + scale * (graph @ (scale * v)))
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        to_right = graph @ side.astype(np.float32)
        gain = np.where(side, graph.sum(1) - 2 * to_right, 2 * to_right - graph.sum(1))  # edges saved by changing sides
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        # Half of the pairs that gain change sides at once; neighbours may have changed too, so not all.
        swaps = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Parts of equal size (by one) by halving again and again; ``parts`` is a power of two."""
    label = np.zeros(len(graph), np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            mine = np.flatnonzero(label == p)
            if len(mine) > 1:
                side = halves(graph[np.ix_(mine, mine)], seed + p)
                label[mine[side]] = p + count
        count *= 2
    return label


class Router:
    """Softmax regression that scores every partition for the direction of a vector."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-30)
        return x @ self.weights[:-1] + self.weights[-1]

    def packed(self) -> bytes:
        return self.weights.tobytes()

    @classmethod
    def unpacked(cls, packed: bytes, dim: int) -> Router:
        return cls(np.frombuffer(packed, np.float64).reshape(dim + 1, -1))

    @classmethod
    def fitted(cls, x: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Router:
        """``target``: per vector, the shares of its own partition and its neighbours'. Gradient descent with momentum from
        the partitions' mean directions."""
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-30)
        means = x.T @ target / (target.sum(0) + 1e-12)
        w = np.vstack([8.0 * means / (np.linalg.norm(means, axis=0) + 1e-12), np.log(target.mean(0) + 1e-6)[None, :]])
        x1, move = np.hstack([x, np.ones((len(x), 1))]), np.zeros_like(w)
        for _ in range(rounds):
            z = x1 @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            move = 0.9 * move - rate * (x1.T @ (p - target) / len(x) * p.shape[1] ** 0.5 + decay * w)
            w = w + move
        return cls(w)


def _nearest_of(q: np.ndarray, x: np.ndarray, k: int, own: bool) -> np.ndarray:
    near = q @ x.T
    if own:
        np.fill_diagonal(near, -np.inf)
    return np.argpartition(-near, k - 1, axis=1)[:, :k]


def probes_for(q: np.ndarray, x: np.ndarray, router: Router, k: int, recall: float) -> int:
    """The fewest partitions that hold the share ``recall`` of the ``k`` nearest in ``x`` of vectors the router has not seen."""
    k = min(k, len(x))
    if not len(q) or k < 1:
        return router.weights.shape[1]
    top = _nearest_of(q, x, k, False)
    place = np.argsort(np.argsort(-router.logits(q), axis=1, kind="stable"), axis=1, kind="stable")
    needed = place[np.arange(len(q))[:, None], router.logits(x).argmax(1)[top]].ravel()
    return int(np.sort(needed)[int(np.ceil(recall * len(needed))) - 1]) + 1


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, int]:
    """Partition the neighbour graph of four fifths of ``x``, learn where a vector's neighbours are, and read off the rest how many
    partitions a query must probe."""
    held = x[len(x) - len(x) // 5 :]
    x = x[: len(x) - len(held)]
    label = balanced_parts(neighbour_graph(x, DEGREE), parts)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), label] = 1.0
    near = min(DEGREE, len(x) - 1)
    if near:
        np.add.at(target, (np.arange(len(x))[:, None], label[_nearest_of(x, x, near, True)]), 1.0 / near)
    router = Router.fitted(x, target / target.sum(1, keepdims=True))
    return router, probes_for(held, x, router, k, recall)


def parts_for(rows: int, sample: int) -> int:
    """A power of two: partitions of about PART_ROWS rows, but LEAST_PART sample vectors in each."""
    most = min(max(1, rows // PART_ROWS), max(1, min(rows, sample) * 4 // 5 // LEAST_PART))
    return 1 << (most.bit_length() - 1)


def _best(router: Router, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The most probable partitions of each vector, and their log probabilities."""
    z = router.logits(x)
    z = z - z.max(1, keepdims=True)
    z = z - np.log(np.exp(z).sum(1, keepdims=True))
    best = np.argsort(-z, axis=1, kind="stable")[:, :probes]
    return best, np.take_along_axis(z, best, axis=1)


def _spread(batch: pd.DataFrame, part: np.ndarray, width: int) -> pd.DataFrame:
    return pd.DataFrame({"id": batch["id"].repeat(width), "v": batch["v"].repeat(width), "part": part})


def _routed(vectors: DataFrame, router: Router, probes: int, kind: str) -> DataFrame:
    """id, v, part: one row per vector and probed partition. Vectors of another length than the sample's go nowhere."""
    dim = len(router.weights) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["v"].map(len) == dim]
            if len(batch):
                best, _ = _best(router, np.stack(batch["v"].to_list()).astype(np.float64), probes)
                yield _spread(batch, best.ravel().astype(np.int64), best.shape[1])

    return vectors.mapInPandas(run, f"id long, v array<{kind}>, part long")


def _refined(rows: DataFrame, models: DataFrame, wider: int | None, kind: str) -> DataFrame:
    """``rows`` with ``part`` replaced by partitions of it, where ``models`` (part, dim, probes, weights, pieces) has a router for it.

    A router travels to its partition's rows as a row of its own, once per piece, so that neither a large partition nor many
    routers meet in one place. ``wider`` None keeps the most probable partition alone; else so many times the probes.
    """
    routers = models.select("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "dim", "probes", "weights")
    pieces = broadcast_if_small(models.select(F.col("part").alias("m_part"), "pieces"))
    cut = rows.join(pieces, F.col("part") == F.col("m_part"), "left").drop("m_part")
    whole = cut.where("pieces is null").drop("pieces")
    cut = cut.where("pieces is not null").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = cut.select("part", "piece", "id", "v", none("dim", "int"), none("probes", "int"), none("weights", "binary")).unionByName(
        routers.select("part", "piece", none("id", "long"), none("v", f"array<{kind}>"), "dim", "probes", "weights")
    )
    both = both.repartition("part", "piece").sortWithinPartitions("part", "piece", F.col("weights").isNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, router, dim, probes = None, None, 0, 0
        for batch in batches:
            for (part, piece), group in batch.groupby(["part", "piece"], sort=False):
                lead = group["weights"].notna()
                if lead.any():
                    row = group[lead].iloc[0]
                    at, dim, probes = (part, piece), int(row["dim"]), int(row["probes"])
                    router = Router.unpacked(row["weights"], dim)
                group = group[~lead]
                group = group[group["v"].map(len) == dim]
                if (part, piece) != at or not len(group):
                    continue
                best, _ = _best(router, np.stack(group["v"].to_list()).astype(np.float64), 1 if wider is None else probes * wider)
                yield _spread(group, (part + 1) * MOST_PARTS + best.ravel(), best.shape[1])  # no other partition has this number

    deeper = both.mapInPandas(run, f"id long, v array<{kind}>, part long")
    return whole.select("id", "v", "part").unionByName(deeper)


def _routers(index: DataFrame, large: DataFrame, k: int, recall: float, sample: int) -> DataFrame:
    """part, dim, probes, weights, pieces: a router inside each large partition, fitted on a bounded sample of its rows."""
    order = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
    some = index.join(broadcast_if_small(large), "part").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        dims = group["v"].map(len)
        dim = int(dims.mode().min())
        x = np.stack(group["v"][dims == dim].to_list()).astype(np.float64)
        rows = int(group["n"].iloc[0])
        router, probes = fit(x, parts_for(rows, len(x)), k, recall)
        pieces = -(-rows // PIECE_ROWS)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "dim": [dim], "probes": [probes], "weights": [router.packed()], "pieces": [pieces]})

    return some.select("part", "n", "place", "v").groupBy("part").applyInPandas(learn, "part long, dim int, probes int, weights binary, pieces int")


def _block_search(k: int):
    def run(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            q = np.stack(queries["v"].to_list()).astype(np.float64)
            x = np.stack(rows["v"].to_list()).astype(np.float64)
            ids = rows["id"].to_numpy()
            near = q @ x.T
            slack = 1e-12 * np.abs(q).sum(1) * np.abs(x).max(initial=0)
            for i, query in enumerate(queries["id"].to_numpy()):
                line = np.where(ids == query, -np.inf, near[i])
                kth = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                some = np.flatnonzero((line >= kth - slack[i]) & (line > -np.inf))
                exact = (x[some] * q[i]).sum(1)  # the same order of additions for every row: equal vectors have equal scores
                order = np.lexsort((ids[some], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[some][order], "score": exact[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def _met(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's best of every block of the partitions it probes."""
    rows_per = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    queries_per = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    plan = broadcast_if_small(stored(rows_per.join(queries_per, "part"), "ann-plan"))
    dealt = index.join(plan, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("part", "block", "group", "id", "v")
    put = asked.join(plan, "part").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    put = put.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    put = put.select(F.col("part").alias("q_part"), F.col("block").alias("q_block"), F.col("group").alias("q_group"), "id", "v")
    found = put.groupBy("q_part", "q_block", "q_group").cogroup(dealt.groupBy("part", "block", "group"))
    return found.applyInPandas(_block_search(k), "query_id long, vec_id long, score double")


class Index:
    """Every row of a table in its most probable partition; partitions with many rows are partitioned again."""

    def __init__(self, vectors: DataFrame, id_col: str, vector: str, k: int = 20, recall: float = 0.95, sample: int = SAMPLE):
        kind = vectors.schema[vector].dataType.elementType.simpleString()
        self.id_col, self.vector, self.kind = id_col, vector, kind if kind in ("float", "double") else "double"
        rows = self._usable(vectors).dropDuplicates(["id", "v"])
        n = rows.count()
        self.parts, self.router, self.levels = parts_for(n, sample), None, []
        got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        if not len(got):
            return
        dims = got["v"].map(len)
        x = np.stack(got["v"][dims == dims.mode().min()].to_list()).astype(np.float64)
        self.parts = parts_for(n, len(x))
        self.router, self.probes = fit(x, self.parts, k, recall)
        self.index = written_once(_routed(rows, self.router, 1, self.kind), "ann-index")
        while True:
            large = self.index.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_PART)
            if len(self.levels) == 5 or not large.limit(1).count():
                break
            models = written_once(_routers(self.index, large, k, recall, sample), "ann-routers")
            self.levels.append(models)
            self.index = written_once(_refined(self.index, models, None, self.kind), "ann-index")

    def _usable(self, df: DataFrame) -> DataFrame:
        kept = df.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vector).cast(f"array<{self.kind}>").alias("v"))
        return usable(kept.where("id is not null"), "v")

    def _asked(self, queries: DataFrame, wider: int) -> DataFrame:
        asked = _routed(queries, self.router, min(self.probes * wider, self.parts), self.kind)
        for models in self.levels:
            asked = _refined(asked, models, wider, self.kind)
        return asked

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """query_id, vec_id, score: at least the ``k`` nearest found of each query, or every other row if there are fewer.

        A query whose partitions hold too few rows goes on with eight times as many, until it has ``k`` or has seen all.
        """
        queries = written_once(self._usable(queries).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
        parts, wider, left = [], 1, queries
        while True:
            asked = written_once(self._asked(left, wider), "ann-asked")
            found = written_once(_met(self.index, asked, k), "ann-found")
            if wider >= MOST_PARTS:
                parts.append(found)
                break
            full = found.groupBy("query_id").agg(F.count_distinct("vec_id", "score").alias("n")).where(F.col("n") >= k)
            left = written_once(left.join(full, F.col("id") == F.col("query_id"), "left_anti"), "ann-short")
            parts.append(found.join(left.select(F.col("id").alias("query_id")), "query_id", "left_anti"))
            if not left.limit(1).count():
                break
            wider *= 8
        return reduce(DataFrame.unionByName, parts)


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 20, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found by inner product in double precision.

    All rows of ``vectors`` are indexed: each goes to its most probable partition, and a partition with many rows is
    partitioned again by a router of its own, so partitions grow in number with the table, not in size. A query looks at its
    most probable partitions, as many as reached ``recall`` for vectors that the routers were not fitted on, and at more where these hold fewer than
    ``k`` rows: it gets ``k`` rows, or all candidates if there are fewer. A partition is read in blocks of bounded size, so one that holds many equal vectors is
    spread over tasks. Routers are fitted on at most ``sample`` vectors each. Vectors that are null, zero, hold null or
    non-finite numbers or have another length than most take no part. A row is no neighbour of a query with its id; rows
    that repeat an id count once per different vector; a query id that repeats asks with its smallest vector. Ties go to the smaller id. Empty tables
    give no rows.
    """
    made = Index(vectors, id_col, vector, k, recall, sample)
    if made.router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = made.search(queries, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
