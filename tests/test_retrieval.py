"""Retrieval against plain loops, with and without split blocks."""

import math
import random

import numpy as np
import pytest

from cuewright.operators import player, retrieval


def unit(rng, n=6):
    v = np.array([rng.gauss(0, 1) for _ in range(n)])
    return (v / np.linalg.norm(v)).tolist()


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest(spark, block, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = random.Random(1)
    chunks = [("hot" if i % 3 else "cold", i, unit(rng)) for i in range(60)]
    queries = [("hot" if i % 2 else "cold", i, unit(rng)) for i in range(30)] + [("none", 99, unit(rng))]
    found = retrieval.nearest(
        spark.createDataFrame(chunks, "video_id string, chunk_id long, vec array<double>"),
        spark.createDataFrame(queries, "video_id string, query_id long, vec array<double>"),
        5,
    ).collect()
    got = {q: [(r.chunk_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for _, q, _ in queries}
    for video, q, vec in queries:
        scored = sorted((-round((1 + float(np.dot(vec, v))) / 2, 6), c) for w, c, v in chunks if w == video)[:5]
        assert got[q] == [(c, -s) for s, c in scored]


def plain_bm25(texts, question, k):
    docs = [t.split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    idf = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in vocabulary}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    score = [
        round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in question.split()), 6)
        for d in docs
    ]
    return [(i, score[i]) for i in sorted(range(n), key=lambda i: (-score[i], i))[:k]]


def test_bm25_with_repeats_zero_and_negative_scores(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    texts = {v: [" ".join(rng.choice(words[: 3 + 4 * (v == "x")]) for _ in range(rng.randint(1, 12))) for _ in range(n)] for v, n in (("x", 25), ("y", 3))}
    asked = [(1, "x", "a a g"), (2, "x", "zzz"), (3, "y", "a b zzz"), (4, "x", "a b c d e f g"), (5, "y", "")]
    corpus = spark.createDataFrame([(v, i, t) for v, ts in texts.items() for i, t in enumerate(ts)], "video_id string, chunk_id long, text string")
    found = retrieval.bm25_topk(corpus, spark.createDataFrame(asked, "query_id long, video_id string, question string"), 6).collect()
    for q, v, text in asked:
        got = [(r.chunk_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        want = plain_bm25(texts[v], text, 6)
        assert [c for c, _ in got] == [c for c, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_fusion_adds_equal_texts(spark):
    rows = [(1, "v", 10, 0, 0, "same"), (1, "v", 11, 0, 1, "other"), (1, "v", 12, 1, 0, "same"), (1, "v", 13, 1, 1, "same"), (1, "v", 14, 1, 2, "late")]
    got = retrieval.rrf_fuse(spark.createDataFrame(rows, "query_id long, video_id string, chunk_id long, list int, rank long, text string")).orderBy("rank").collect()
    assert [(r.text, r.chunk_id) for r in got] == [("same", 13), ("other", 11), ("late", 14)]
    assert got[0].score == pytest.approx(2 / 61 + 1 / 62, abs=1e-9)


def test_threshold_and_fallback(spark):
    rows = [(1, i, s, i) for i, s in enumerate([0.9, 0.6, 0.5])] + [(2, i, s, i) for i, s in enumerate([0.5, 0.4, 0.3, 0.2])]
    got = retrieval.dense_threshold(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank long"), 0.55, 3).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_ann_is_a_subset_with_exact_scores(spark):
    rng = random.Random(3)
    rows = [("v", i, unit(rng, 8)) for i in range(80)]
    chunks = spark.createDataFrame(rows, "video_id string, chunk_id long, vec array<float>")
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id): r.score for r in retrieval.nearest(chunks, queries, 80).collect()}
    found = retrieval.ann_topk(chunks, queries, 5).collect()
    assert all(r.score == pytest.approx(exact[r.query_id, r.chunk_id], abs=1e-6) for r in found)
    assert {r.query_id for r in found if r.chunk_id == r.query_id} == set(range(80))


def test_custom_encoder_runs_on_batches(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    chunks = spark.createDataFrame([("v", 0, "abc"), ("v", 1, "")], "video_id string, chunk_pos long, text string")
    got = retrieval.embed_chunks(chunks, "p", "m", make).orderBy("chunk_pos").collect()
    assert [list(r.vec) for r in got] == [[3.0, 1.0], [0.0, 1.0]] and got[0].embedding_model == "m"


def test_history_lines(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f" line {i}\n x ") for i in range(9)] + [(1, 9, "system", "  ")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = player.format_history(player.request_history(messages)).first().history.split("\n")
    assert got == ["User: line 4 x", "Assistant: line 5 x", "User: line 6 x", "Assistant: line 7 x", "User: line 8 x"]
