"""Shapes of input that the small tables do not have."""

import glob

import numpy as np
import pytest

from cuewright.catalog import QUERIES, q_sequence
from cuewright.operators import retrieval
from cuewright.session import scratch_path, shared_folder
from cuewright.streaming import streams
from tests.test_streams import deliver


def test_run_log_whose_first_file_has_no_rows(spark):
    schema = "video_id string, seq long, status string"
    frames = [spark.createDataFrame(r, schema) for r in ([], [("r", 2, "b")], [("r", 1, "a"), ("q", 1, "x")])]
    path = scratch_path(spark, "runs")
    streams.stream_run_log(deliver(spark, frames), path, scratch_path(spark, "cp"), ["status"]).awaitTermination()
    assert {(r.video_id, r.status) for r in spark.read.parquet(path).collect()} == {("r", "b"), ("q", "x")}


VECTORS = "video_id string, chunk_id long, vec array<double>"


def test_nearest_calls_python_for_many_small_videos_at_once(spark):
    x = np.random.default_rng(7).normal(size=(900, 6))
    chunks = spark.createDataFrame([(f"v{i // 3}" if i > 2 else None, i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    asked = chunks.withColumnRenamed("chunk_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(900):
        own = range(i - i % 3, i - i % 3 + 3)
        best = sorted((-round(float((1 + unit[i] @ unit[j]) / 2), 6), j) for j in own)[:2]
        want |= {(i, rank, j, -score) for rank, (score, j) in enumerate(best)}
    found = retrieval.nearest(chunks, asked, 2)
    assert {(r.query_id, r["rank"], r.chunk_id, r.score) for r in found.collect()} == want
    assert "_group" in found._jdf.queryExecution().toString()  # before: a call for each video


def test_sparse_search_over_many_videos_shuffles_no_words(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]

    def text(n):
        return " ".join(rng.choice(words, n)) + " \t\u2003 "

    corpus = [(f"v{v}", c, text(int(rng.integers(1, 9)))) for v in range(40) for c in range(int(rng.integers(1, 6)))]
    corpus = spark.createDataFrame([*corpus, ("v1", 70, None), ("v2", 71, ""), *corpus[:5]], "video_id string, chunk_id long, text string")
    asked = [(q, f"v{q % 42}", text(6)) for q in range(60)] + [(90, "v3", None), (91, "v3", "")]
    asked = spark.createDataFrame(asked, "query_id long, video_id string, question string")
    want = sorted(map(tuple, retrieval.bm25_topk(corpus, asked, 4).collect()))
    monkeypatch.setattr(retrieval, "MANY_VIDEOS", 3)
    monkeypatch.setattr(retrieval, "ASKED_TERMS", 2)
    monkeypatch.setattr(retrieval, "_spread_postings", None)
    assert sorted(map(tuple, retrieval.bm25_topk(corpus, asked, 4).collect())) == want


def test_stream_index_delivers_files_of_many_tasks(spark, tmp_path):
    docs = [(d, "\n".join(f"line {i} of {d}, long enough to be kept" for i in range(12)), "en", "s", 1) for d in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/cuewright/segments-*"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["stream_index"](spark, str(tmp_path)).select("video_id", "segment_start", "segment_end").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    made = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/cuewright/segments-*")) - before
    assert len([f for d in made for f in glob.glob(f"{d}/*.parquet")]) > 4  # before: one file, written by one task, for each delivery
    assert {r.video_id for r in found} == {f"d{d}" for d in range(40)} and max(r.segment_end for r in found) == 11


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["scan_words", "sentence_runs", "pseudo_words"])
def test_words_of_documents_are_not_shuffled(spark, tmp_path, name):
    docs = [(d, "\n".join(f"Line {i} of {d}. it goes on, and  ends here" for i in range(20)), "en", "s", 1) for d in range(30)]
    docs += [(31, None, "en", "s", 1), (32, "", "en", "s", 1), (33, " \n ", "en", "s", 1), docs[0], (None, "a b\nc", "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert {r.video_id for r in found.select("video_id").distinct().collect()} >= {f"d{d}" for d in range(30)}
    above, _, below = found._jdf.queryExecution().executedPlan().toString().rpartition("Generate posexplode(")
    assert "hashpartitioning(video_id" in below  # texts are dealt below the first fan-out,
    assert "hashpartitioning" not in above  # and neither lines nor words above it


def test_lines_with_words_keep_repeated_and_unnamed_documents(spark, tmp_path):
    docs = [(1, "a bb\nc", "en", "s", 1), (1, "a bb\nc", "en", "s", 1), (None, "x y\nz", "en", "s", 1), (2, "one\n\ntwo\n3\nfive is none", "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = q_sequence.recogniser(spark, str(tmp_path)).collect()
    words = {(r.video_id, r.seg_idx): [w.word for w in r.words] if r.words is not None else None for r in rows}
    assert len(rows) == 4 + 2 + 5
    assert words["d1", 0] == ["a", "a", "bb", "bb"] and words["d2", 1] == [""] and words["d2", 4] is None and words[None, 0] is None
