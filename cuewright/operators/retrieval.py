"""Retrieval over chunk tables: dense, sparse, fused, with ready-to-use context."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright import fixed_values as fv
from cuewright.functions.text import domain_of, strip
from cuewright.plans.blocked import block_of, dense_position, many_blocks, value_rank
from cuewright.plans.sizes import broadcast_if_small, hinted, is_small
from cuewright.session import passing_tables, written_once


# ---- web results -----------------------------------------------------------------------------
def shape_search_results(results: DataFrame, n: int) -> DataFrame:
    """First ``n`` hits per query, then those without a url are dropped; short snippet and host."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    url = strip(F.coalesce("url", F.lit("")))
    return (
        results.withColumn("_pos", rank)
        .where(F.col("_pos") <= n)
        .where(F.col("url") != "")
        .select(
            "query_id",
            "rank",
            strip(F.coalesce("title", F.lit(""))).alias("title"),
            url.alias("url"),
            domain_of(url).alias("domain"),
            F.substring(strip(F.coalesce("content", F.lit(""))), 1, fv.SNIPPET_CHARS).alias("snippet"),
        )
    )


def format_search_results(shaped: DataFrame) -> DataFrame:
    """One ``[WEB-n]`` block per query from its few shaped hits."""

    def entry(hit: Column, i: Column) -> Column:
        return F.concat(
            F.lit("[WEB-"), i + 1, F.lit("] "), hit["title"], F.lit("\nDomain: "), hit["domain"],
            F.lit("\nURL: "), hit["url"], F.lit("\nSnippet: "), hit["snippet"],
        )

    hits = F.sort_array(F.collect_list(F.struct("rank", "title", "domain", "url", "snippet")))
    return (
        shaped.groupBy("query_id").agg(hits.alias("_hits"))
        .select("query_id", F.array_join(F.transform("_hits", entry), "\n\n").alias("block"))
    )


# ---- dense search ------------------------------------------------------------------------------
# Rows of one similarity block: chunks of a video are split by hash above this, queries likewise.
CHUNK_BLOCK = 4096
QUERY_BLOCK = 1024
# Rows of the keys that are multiplied in one call of Python, on average.
GROUP_ROWS = 8192


def cosine_relevance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Relevance of each row of ``a`` to each of ``b``; a half where one has no direction."""
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    cosine = np.divide(a @ b.T, norms, out=np.zeros((len(a), len(b))), where=norms > 0)
    return np.round(np.clip((1.0 + cosine) / 2.0, 0.0, 1.0), 12)  # equal vectors tie whatever the product's order


def best_places(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest scores of each row, ties to the smaller column; scores below zero are none."""
    kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(score))
    row, column = np.nonzero(score >= np.maximum(kth, 0.0)[:, None])
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def marked_scores(score: np.ndarray, a: np.ndarray, b: np.ndarray, apart: bool) -> Iterator[np.ndarray]:
    """``score`` where a row of ``a`` and one of ``b`` hold the same value at some place, else -1; ``apart``: for one place after the other."""
    found = np.zeros(score.shape, bool)
    for x, y in zip(a.T, b.T):
        same = x[:, None] == y[None, :]
        if apart:
            yield np.where(same, score, -1.0)
        else:
            found |= same
    if not apart:
        yield np.where(found, score, -1.0)


def _products(chunks: DataFrame, queries: DataFrame, keys: list[str]) -> float:
    """Pairs of a chunk and a query with the same ``keys``."""
    asked = queries.groupBy(*keys).agg(F.count("*").alias("_q"))
    pairs = chunks.groupBy(*keys).agg(F.count("*").alias("_c")).join(asked, keys)
    return pairs.agg(F.coalesce(F.sum(F.col("_c").cast("double") * F.col("_q")), F.lit(0.0))).first()[0]


def _block_count(df: DataFrame, keys: list[str], block: int, name: str) -> DataFrame:
    """Keys with more than ``block`` rows and the number of blocks each is split into."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    return broadcast_if_small(counted.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias(name)))


def nearest(
    chunks: DataFrame, queries: DataFrame, k: int, keys: Sequence[str] = ("video_id",), digits: int = 6, marks: str | None = None
) -> DataFrame:
    """``k`` chunks of highest cosine relevance per query among chunks with the same ``keys``.

    ``chunks``: keys, ``chunk_id, vec``; ``queries``: keys, ``query_id, vec``. Both sides are split
    into blocks where a key is large, blocks meet in matrix products, and only each block's best
    ``k`` per query leave it, so neither pairs nor a hot video pile up anywhere. Ranks follow the full score;
    ``digits`` rounds the score that is returned, 12 for one that a threshold is put to. ``marks`` names an array of both sides:
    then only pairs that hold the same value at the same place of it are ranked.
    """
    keys, carried = list(keys), ["vec", *([marks] if marks else [])]
    many_chunks = _block_count(chunks, keys, CHUNK_BLOCK, "_cn")
    many_queries = _block_count(queries, keys, QUERY_BLOCK, "_qn")

    def cut(df: DataFrame, own: DataFrame, own_name: str, own_id: str, other: DataFrame, other_name: str) -> DataFrame:
        one = F.lit(1)
        both = df.join(own, keys, "left").join(other, keys, "left")
        mine = F.pmod(F.xxhash64(own_id), F.coalesce(own_name, one)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other_name, one) - 1))
        names = ("_cb", "_qb") if own_name == "_cn" else ("_qb", "_cb")
        # Aliased afresh: chunks and queries may stem from the same table.
        own_columns = [F.col(c).alias(c) for c in (*keys, own_id, *carried)]
        return both.select(*own_columns, mine.alias(names[0]), theirs.alias(names[1]))

    left = cut(chunks, many_chunks, "_cn", "chunk_id", many_queries, "_qn")
    right = cut(queries, many_queries, "_qn", "query_id", many_chunks, "_cn")
    # Most keys are small, and a call of Python for each would cost more than its products: many keys share a group.
    groups = F.lit(max(1, -(-(left.count() + right.count()) // GROUP_ROWS)))
    cell = F.to_json(F.struct(*keys, "_cb", "_qb"))

    def grouped(df: DataFrame) -> DataFrame:
        return df.withColumn("_cell", cell).withColumn("_group", F.pmod(F.xxhash64("_cell"), groups)).drop("_cb", "_qb").groupBy("_group")

    def best(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("chunk_id")
        chunks_of, found = c.groupby("_cell", sort=False).indices, []
        for owner, asking in q.groupby("_cell", sort=False).indices.items():
            if owner in chunks_of:
                near = chunks_of[owner]
                score = cosine_relevance(*(np.stack(list(x["vec"].to_numpy()[i])).astype("float64") for x, i in ((q, asking), (c, near))))
                scores = [score]
                if marks:
                    repeated = c["chunk_id"].iloc[near].duplicated().any()  # then the k best of all marks would hold fewer than k ids
                    scores = marked_scores(score, *(np.stack(list(x[marks].to_numpy()[i])) for x, i in ((q, asking), (c, near))), repeated)
                for score in scores:
                    row, column = best_places(score, k)
                    found.append((asking[row], near[column], score[row, column]))
        if not found:
            return pd.DataFrame(columns=[*keys, "query_id", "chunk_id", "score"])
        of_query, of_chunk, score = (np.concatenate(x) for x in zip(*found))
        out = {name: q[name].to_numpy()[of_query] for name in (*keys, "query_id")}
        return pd.DataFrame(out | {"chunk_id": c["chunk_id"].to_numpy()[of_chunk], "score": score})

    fields = [chunks.schema[c] for c in keys] + [queries.schema["query_id"], chunks.schema["chunk_id"]]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    found = grouped(left).cogroup(grouped(right)).applyInPandas(best, schema)
    if keys != ["video_id"] or marks:
        found = found.groupBy("video_id", "query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(found, k).withColumn("score", F.round("score", digits))


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Best ``k`` rows per query with a 0-based ``rank``; the limit also applies before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *(ties or ("chunk_id",)))
    ranked = scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    return ranked.withColumn("rank", (F.col("_rn") - 1).cast("long")).drop("_rn")


def dense_threshold(
    ranked: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, fallback: int = fv.FALLBACK_K
) -> DataFrame:
    """Rows above the threshold; the first few of a query where none passes."""
    passing = F.count_if(F.col("score") >= threshold).over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("_pass", passing)
        .where((F.col("score") >= threshold) | ((F.col("_pass") == 0) & (F.col("rank") < fallback)))
        .drop("_pass")
    )


def web_trigger(queries: DataFrame, ranked: DataFrame, threshold: float = fv.WEB_AUTO_THRESHOLD) -> DataFrame:
    """Whether a query (``query_id, mode``) goes to web search, from its best dense score."""
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top_score"))
    score = F.coalesce("top_score", F.lit(0.0))
    fires = (F.col("mode") == "always") | ((F.col("mode") == "auto") & (score < threshold))
    return queries.join(top, "query_id", "left").select(
        "query_id", "mode", score.alias("top_score"), F.when(fires, F.col("mode")).alias("triggered_by")
    )


# ---- sparse search -----------------------------------------------------------------------------
def _tokens(text: str) -> Column:
    other = fv.WHITESPACE.replace(" ", "")
    return F.array_remove(F.split(F.translate(text, other, " " * len(other)), " "), "")


def bm25_stats(corpus: DataFrame, few_videos: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``(videos, terms)``: size and mean length per video; document frequency and idf per term.

    A negative idf becomes a quarter of the video's mean idf over all its terms. A chunk's terms are
    made distinct inside its row, so frequencies are counted by plain partial aggregation. The tables
    with one row per video are broadcast when the number of videos was checked to be small.
    """
    if few_videos is None:
        few_videos = is_small(corpus.select("video_id").distinct())
    rows = corpus.select("video_id", _tokens("text").alias("w"))
    videos = rows.groupBy("video_id").agg(
        F.count("*").alias("n_chunks"), (F.sum(F.size("w")) / F.count("*")).alias("avg_len")
    )
    freq = (
        rows.select("video_id", F.explode_outer(F.array_distinct("w")).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("video_id", "term")
        .agg(F.count("*").alias("df"))
    )
    return videos, with_idf(freq, videos, few_videos)


def with_idf(freq: DataFrame, videos: DataFrame, few_videos: bool) -> DataFrame:
    """Add ``idf`` to document frequencies (``video_id, term, df``, and what else they carry)."""
    n, df = F.col("n_chunks"), F.col("df")
    raw = freq.join(hinted(videos.select("video_id", "n_chunks"), few_videos), "video_id").withColumn(
        "raw", F.log(n - df + 0.5) - F.log(df + 0.5)
    )
    means = raw.groupBy("video_id").agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, fv.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(hinted(means, few_videos), "video_id").select(*freq.columns, idf.alias("idf"))


# Videos beyond which a corpus is laid out by video, and asked terms in one list.
MANY_VIDEOS = 1000
ASKED_TERMS = 1024


def _spread_postings(corpus: DataFrame, asked: DataFrame, few_videos: bool, few_asked: bool) -> tuple[DataFrame, DataFrame]:
    """``(postings, weighted)`` where a few videos hold the chunks: terms are counted where they are read, then shuffled."""
    videos, terms = bm25_stats(corpus, few_videos)
    vocabulary = hinted(asked.select("video_id", "term").distinct(), few_asked)
    postings = (
        corpus.select("video_id", "chunk_id", _tokens("text").alias("w"))
        # The length is taken below the generator, else every term row would drag the whole array.
        .withColumn("len", F.size("w"))
        .select("video_id", "chunk_id", "len", F.explode_outer("w").alias("term"))
        .join(vocabulary, ["video_id", "term"], "left_semi")
        .groupBy("video_id", "chunk_id", "len", "term")
        .agg(F.count("*").alias("tf"))
    )
    weighted = (
        terms.join(hinted(asked, few_asked), ["video_id", "term"])
        .join(hinted(videos, few_videos), "video_id")
        .select("query_id", "video_id", "term", "times", "idf", "avg_len")
    )
    return postings, weighted


def _video_postings(corpus: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(postings, weighted)`` where there are many videos and each fits a block: texts are shuffled by video, their words never.

    The asked terms of a video come to its chunks in lists of about ``ASKED_TERMS``, and only occurrences of these leave a chunk. The
    number of terms with each document frequency is counted inside the video; it gives the mean idf.
    """
    words = corpus.select("video_id", "chunk_id", "text").repartition("video_id")
    words = words.select("video_id", "chunk_id", _tokens("text").alias("w"))
    videos = words.groupBy("video_id").agg(F.count("*").alias("n_chunks"), (F.sum(F.size("w")) / F.count("*")).alias("avg_len"))
    terms = asked.select("video_id", "term").distinct()
    lists = terms.groupBy("video_id").agg(F.ceil(F.count("*") / ASKED_TERMS).alias("_lists"))
    dealt = terms.join(lists, "video_id").withColumn("_list", F.pmod(F.xxhash64("term"), F.col("_lists")))
    listed = dealt.groupBy("video_id", "_list").agg(F.collect_list("term").alias("terms"))

    @F.pandas_udf("array<struct<term string, tf long>>")
    def occurrences(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for w, t in zip(texts, wanted):
            known = set(t)
            out.append([{"term": x, "tf": n} for x, n in Counter(x for x in w if x in known).items()])
        return pd.Series(out)

    rows = words.where(F.col("w").isNotNull()).join(listed, "video_id")
    found = rows.select("video_id", "chunk_id", F.size("w").alias("len"), F.explode(occurrences("w", "terms")).alias("p"))
    found = written_once(found.select("video_id", "chunk_id", "len", "p.term", "p.tf"), "occurrences")
    frequency = found.groupBy("video_id", "term").agg(F.count("*").alias("df"))
    postings = found.groupBy("video_id", "chunk_id", "len", "term").agg(F.sum("tf").alias("tf"))

    def raw(df: str) -> Column:
        n = F.col("n_chunks")
        return F.log(n - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)

    every = words.select("video_id", F.explode_outer(F.array_distinct("w")).alias("term")).where(F.col("term").isNotNull())
    levels = every.groupBy("video_id", "term").agg(F.count("*").alias("df")).groupBy("video_id", "df").agg(F.count("*").alias("same"))
    means = levels.join(videos.select("video_id", "n_chunks"), "video_id").groupBy("video_id")
    means = means.agg((F.sum(raw("df") * F.col("same")) / F.sum("same")).alias("mean_idf"))
    known = written_once(videos.join(means, "video_id"), "video-terms")
    idf = F.when(raw("df") < 0, fv.BM25_EPSILON * F.col("mean_idf")).otherwise(raw("df"))
    weighted = asked.join(frequency, ["video_id", "term"]).join(known, "video_id")
    return postings, weighted.select("query_id", "video_id", "term", "times", idf.alias("idf"), "avg_len")


def bm25_topk(corpus: DataFrame, questions: DataFrame, k: int = fv.FETCH_K) -> DataFrame:
    """Okapi BM25 over all chunks of the asked video; ``k`` chunks per question even at score 0.

    ``corpus``: ``video_id, chunk_id, text``; ``questions``: ``query_id, video_id, question``. Only
    postings of asked terms are joined; a term asked twice counts twice. The asked side is broadcast
    when its rows were counted to be few; beyond that it is a shuffle join, whose skewed terms
    adaptive execution splits. The scored pairs are written once, since three steps read them.
    """
    few_videos = is_small(corpus.select("video_id").distinct())
    asked = (
        questions.select("query_id", "video_id", F.explode(_tokens("question")).alias("term"))
        .groupBy("query_id", "video_id", "term")
        .agg(F.count("*").alias("times"))
    )
    few_asked = is_small(asked)
    with passing_tables(corpus.sparkSession) as keep:
        matched = keep(_matched(corpus, asked, few_videos, few_asked))
    return top_k(matched.unionByName(_zero_scored(corpus, questions, matched, k)), k)


def _matched(corpus: DataFrame, asked: DataFrame, few_videos: bool, few_asked: bool) -> DataFrame:
    """query_id, video_id, chunk_id, score of every chunk that holds an asked term, written once."""
    if is_small(corpus.select("video_id").distinct(), MANY_VIDEOS) or many_blocks(corpus, "chunk_id"):
        postings, weighted = _spread_postings(corpus, asked, few_videos, few_asked)
    else:
        postings, weighted = _video_postings(corpus, asked)
    tf = F.col("tf")
    norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * F.col("len") / F.col("avg_len"))
    gain = F.col("times") * F.col("idf") * tf * (fv.BM25_K1 + 1) / (tf + norm)
    return written_once(
        postings.join(hinted(weighted, few_asked), ["video_id", "term"])
        .groupBy("query_id", "video_id", "chunk_id")
        .agg(F.round(F.sum(gain), 6).alias("score")),
        "matched",
    )


def _zero_scored(
    corpus: DataFrame, questions: DataFrame, matched: DataFrame, k: int
) -> DataFrame:
    """First unmatched chunks of questions with fewer than ``k`` positive scores.

    Among the first ``matched + k`` chunks of a video at least ``k`` are unmatched, so only those meet
    the question. Videos without such a question drop out before anything is sorted.
    """
    hits = matched.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("positive"))
    needy = (
        questions.select("query_id", "video_id")
        .join(hits, "query_id", "left")
        .where(F.coalesce("positive", F.lit(0)) < k)
        .select("query_id", "video_id", (F.coalesce("n", F.lit(0)) + k).alias("upto"))
    )
    reach = needy.groupBy("video_id").agg(F.max("upto").alias("reach"))
    ids = corpus.select("video_id", "chunk_id").join(reach, "video_id")
    many = many_blocks(corpus, "chunk_id")
    placed = dense_position(ids, ["video_id"], ["chunk_id"], block_of("chunk_id"), "pos", many)
    return (
        placed.where(F.col("pos") < F.col("reach"))
        .join(needy, "video_id")
        .where(F.col("pos") < F.col("upto"))
        .select("query_id", "video_id", "chunk_id")
        .join(matched, ["query_id", "video_id", "chunk_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )


# ---- fusion ------------------------------------------------------------------------------------
def rrf_fuse(ranked: DataFrame, k: int = fv.RRF_K, final_k: int = fv.FINAL_K) -> DataFrame:
    """Reciprocal rank fusion on chunk text (``query_id, video_id, chunk_id, list, rank, text``).

    Equal texts add up, also within one list; ties keep the order of first appearance. The shuffle
    carries at most the ranked rows of each query.
    """
    seen = F.struct("list", "rank")
    fused = ranked.groupBy("query_id", "video_id", "text").agg(
        F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 9).alias("score"),
        F.min(seen).alias("first_seen"),
        F.max_by("chunk_id", seen).alias("chunk_id"),
    )
    return top_k(fused, final_k, "first_seen").drop("first_seen")


def text_key(text: Column) -> Column:
    """A text's name in 16 bytes, by which rankings are fused; no bytes for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def hybrid_retrieve(
    corpus: DataFrame,
    questions: DataFrame,
    fetch_k: int = fv.FETCH_K,
    final_k: int = fv.FINAL_K,
    threshold: float = fv.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Dense and sparse rankings, fused (``corpus``: chunk text and ``vec``; ``questions``: text and ``vec``).

    Rankings are fused by their texts' names and written, a few numbers a row; a text meets only the rows that stay.
    """
    texts = corpus.select("video_id", "chunk_id", "text", text_key(F.col("text")).alias("_key"))
    with passing_tables(corpus.sparkSession) as keep:
        dense = dense_threshold(nearest(corpus, questions, fetch_k, digits=12), threshold)
        sparse = bm25_topk(texts.drop("_key"), questions, fetch_k)
        both = dense.withColumn("list", F.lit(0)).unionByName(sparse.withColumn("list", F.lit(1))).drop("score")
        named = both.join(texts.select("video_id", "chunk_id", F.col("_key").alias("text")), ["video_id", "chunk_id"])
        fused = keep(written_once(rrf_fuse(named, final_k=final_k).withColumnRenamed("text", "_key"), "fused"))
    own = ["video_id", "chunk_id", "_key"]
    return fused.join(texts.dropDuplicates(own), own).select("query_id", "video_id", "text", "score", "chunk_id", "rank")


# ---- encoders and approximate search -------------------------------------------------------------
class FirstBytes(dict):
    """First byte of a word's digest, remembered for a bounded number of words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = hashlib.md5(word.encode()).digest()[0]
        return value


def term_shares(texts: Sequence[str | None], first_bytes: FirstBytes) -> np.ndarray:
    """One row of 256 numbers per text: its terms counted by first byte, unit length."""
    words = [t.split() if t else () for t in texts]  # str.split takes fv.WHITESPACE for white space
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    place = np.fromiter(map(first_bytes.__getitem__, chain.from_iterable(words)), np.int64, len(row))
    counts = np.bincount(row * 256 + place, minlength=256 * len(words)).reshape(-1, 256).astype(np.float64)
    length = np.sqrt((counts * counts).sum(axis=1))
    return counts / np.where(length > 0, length, 1.0)[:, None]


def hash_vectors(df: DataFrame, text: str = "text", kind: str = "float") -> DataFrame:
    """Default encoder: counts of the terms whose digest starts with the same byte, unit length, 256 numbers.

    Equal texts have equal vectors on every machine and version; a text without terms has zeros. ``kind``: float or double.
    """

    @F.arrow_udf(f"array<{kind}>")
    def unit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first_bytes, number = FirstBytes(), pa.float64() if kind == "double" else pa.float32()
        for batch in batches:
            values = term_shares(batch.to_pylist(), first_bytes).ravel().astype(number.to_pandas_dtype())
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * 256), pa.array(values, number))

    return df.withColumn("vec", unit(F.col(text)))


def embed_chunks(
    chunks: DataFrame,
    provider: str,
    model: str,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    kind: str = "float",
) -> DataFrame:
    """Add ``vec`` and the provider stamp. ``make_encoder`` runs once per task and encodes batches."""
    if make_encoder is None:
        encoded = hash_vectors(chunks, kind=kind)
    else:

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = make_encoder()
            for batch in batches:
                yield pd.Series(list(np.asarray(encoder(batch.tolist()), dtype="float32")))

        encoded = chunks.withColumn("vec", encode("text"))
    return encoded.withColumns({"embedding_provider": F.lit(provider), "embedding_model": F.lit(model)})


def ann_topk(
    chunks: DataFrame, queries: DataFrame, k: int, tables: int = 8, bucket: float = 1.0, seed: int = 7
) -> DataFrame:
    """Approximate neighbours: random projections choose candidates, exact cosine ranks them.

    Candidates share a projection bucket inside their video. Each bucket goes through ``nearest``, so
    a crowded bucket is split and never emits its pairs. Where buckets are so wide that most pairs share several, a video's vectors
    meet once instead, and the pairs that share no bucket are left out; the candidates are the same.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def features(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", array_to_vector(F.col("vec").cast("array<double>")))

    lsh = BucketedRandomProjectionLSH(
        inputCol="_f", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed
    )
    model = lsh.fit(features(chunks))

    def hashed(df: DataFrame, own: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rows = model.transform(features(df)).select("video_id", own, "vec", F.posexplode("_h").alias("table", "_v"))
        return rows.select("video_id", own, "vec", "table", vector_to_array("_v")[0].cast("long").alias("bucket"))

    def marked(df: DataFrame, own: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return model.transform(features(df)).select("video_id", own, "vec", F.transform("_h", lambda v: vector_to_array(v)[0].cast("long")).alias("buckets"))

    left, right, keys = hashed(chunks, "chunk_id"), hashed(queries, "query_id"), ["video_id", "table", "bucket"]
    if _products(left, right, keys) < _products(chunks, queries, ["video_id"]):
        return nearest(left, right, k, keys)
    return nearest(marked(chunks, "chunk_id"), marked(queries, "query_id"), k, marks="buckets")


# ---- context -----------------------------------------------------------------------------------
def build_context(
    questions: DataFrame, ranked: DataFrame, summaries: DataFrame, web: DataFrame, histories: DataFrame
) -> DataFrame:
    """Context text per question; absent parts are left out.

    ``ranked``: final chunks with ``rank, text``; ``summaries``: ``video_id, summary``; ``web``:
    ``query_id, block``; ``histories``: ``query_id, history``.
    """
    gathered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    quoted = ranked.groupBy("query_id").agg(
        F.array_join(F.transform(gathered, lambda x: x["text"]), "\n\n").alias("chunks")
    )
    # Cut where they are read, and joined first: the other parts are all joined by question, in one place.
    summary = F.substring(strip(F.coalesce("summary", F.lit(""))), 1, fv.SUMMARY_CONTEXT_CHARS)
    summaries = summaries.select("video_id", summary.alias("summary"))

    def part(head: str, body: Column) -> Column:
        return F.when(body != "", F.concat(F.lit(head), body))

    text = F.concat_ws(
        "\n\n",
        F.lit(fv.CONTEXT_POLICY),
        part(fv.CONTEXT_SUMMARY, F.coalesce("summary", F.lit(""))),
        F.concat(F.lit(fv.CONTEXT_CHUNKS), F.coalesce("chunks", F.lit(fv.CONTEXT_NO_CHUNKS))),
        part(fv.CONTEXT_WEB, F.col("block")),
        part(fv.CONTEXT_HISTORY, F.col("history")),
        F.concat(F.lit(fv.CONTEXT_QUESTION), F.col("question")),
    )
    return (
        questions.join(summaries, "video_id", "left")
        .join(quoted, "query_id", "left")
        .join(web, "query_id", "left")
        .join(histories, "query_id", "left")
        .select("query_id", text.alias("context"))
    )


def length_buckets(items: DataFrame, batch_size: int) -> DataFrame:
    """Batches of items of similar length per video (``video_id, seg_idx, seconds``), shortest first.

    Ranks by whole milliseconds; the result is also laid out by length for a following task-wise
    encoder.
    """
    timed = items.withColumn("_ms", F.round(F.col("seconds") * 1000).cast("long"))
    ranked = value_rank(timed, ["video_id"], "_ms", "seg_idx")
    return (
        ranked.withColumn("batch_no", F.floor(F.col("rank") / batch_size).cast("long"))
        .drop("_ms")
        .repartitionByRange("video_id", "rank")
        .sortWithinPartitions("video_id", "rank")
    )
