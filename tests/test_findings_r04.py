"""Findings of round 4: shuffle files and scratch tables go when nothing reads them, and texts are not shuffled where their names do."""

import os
import random

import pytest

from cuewright.catalog import QUERIES, q_state
from cuewright.llm import imatch, jaccard_join, mixing
from cuewright.operators import indexing, postings, retrieval
from cuewright.session import passing_tables, scratch_path, shared_folder, written_once
from cuewright.sources import sinks


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}


def scratch(spark):
    home = f"{shared_folder(spark)}/cuewright"
    return {f for f in os.listdir(home)} if os.path.isdir(home) else set()


def kinds(names):
    return sorted(n.rsplit("-", 1)[0] for n in names)


def words(seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei"]) + str(rng.randrange(40)) for _ in range(n))


def settled(spark, before):
    """Shuffle files are removed in the background."""
    import time

    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = written_once(spark.range(1000).repartition(3, "id").groupBy("id").count(), "freed")
    assert settled(spark, before) and table.count() == 1000  # before: they stayed until the driver collected its garbage
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_passing_tables(spark):
    before = scratch(spark)
    with passing_tables(spark) as keep:
        written_once(spark.range(3), "goes")
        with passing_tables(spark) as inner:
            a = inner(written_once(spark.range(5), "passes"))
            written_once(spark.range(3), "goes")
        b = keep(written_once(a.where("id > 2"), "stays"))
    assert kinds(scratch(spark) - before) == ["stays"] and b.count() == 2
    with pytest.raises(ValueError), passing_tables(spark):
        written_once(spark.range(3), "goes")
        raise ValueError
    assert kinds(scratch(spark) - before) == ["stays"]


def test_near_copies_leave_ids_alone(spark):
    text = words(1)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text), (4, words(2)), (5, None), (None, text)], "doc_id long, text string")
    before = scratch(spark)
    out = jaccard_join.one_of_each(docs, 3, 50)
    assert kinds(scratch(spark) - before) == ["jaccard-kept"]  # before: 19 tables, sets and cells among them
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5]


def test_mixed_documents_leave_counts_alone(spark):
    docs = spark.createDataFrame([(i, words(i), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    before = scratch(spark)
    assert mixing.mixed_documents(docs).count() > 40
    assert kinds(scratch(spark) - before) == ["mix-taken"]


def test_a_large_lexicon_is_held_as_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(i, 5 + i % 40)) for i in range(80)] + [(90, None), (91, ""), (None, words(91)), (0, words(0))], "doc_id long, text string")
    want = sorted(imatch.fingerprints(docs).collect(), key=str)
    monkeypatch.setattr(imatch, "MAX_BROADCAST", 3)
    plans = []
    monkeypatch.setattr(imatch, "written_once", lambda df, name: (plans.append((name, df._jdf.queryExecution().toString())), written_once(df, name))[1])
    before = scratch(spark)
    assert sorted(imatch.fingerprints(docs).collect(), key=str) == want
    assert kinds(scratch(spark) - before) in (["imatch-prints"], ["imatch-whole"])
    assert "hashpartitioning(term" not in dict(plans)["imatch-prints"]  # before: all terms with their texts' keys were shuffled
    monkeypatch.setattr(imatch, "MAX_HELD", 3)
    assert sorted(imatch.fingerprints(docs).collect(), key=str) == want


def chunks(spark, texts):
    rows = [(f"v{i % 3}", i // 3, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "video_id string, chunk_id long, text string")


def test_an_index_leaves_its_four_tables_alone(spark):
    corpus, path, before = chunks(spark, [words(i) for i in range(60)]), scratch_path(spark, "postings"), scratch(spark)
    postings.write_postings(corpus, path)
    postings.write_postings(corpus.where("video_id = 'v1'"), path, replaced=corpus.where("video_id <> 'v0'").select("video_id").distinct())
    assert kinds(scratch(spark) - before) == ["postings"]  # before: 13 tables beside it
    assert spark.read.parquet(f"{path}/chunks").select("video_id").distinct().count() == 2


def test_deliveries_leave_the_index_alone(spark):
    path, before = scratch_path(spark, "index"), scratch(spark)
    for delivery in range(3):
        lines = [(f"v{i % 4}", delivery * 10 + i // 4, i / 1.0, i + 1.0, words(i + 50 * delivery)) for i in range(40)]
        rows = spark.createDataFrame(lines, "video_id string, seg_idx long, start double, end double, text string")
        todo = indexing.append_and_index(rows, path, delivery)
        assert todo.count() == 4
    left = kinds(scratch(spark) - before)
    assert left.count("todo") == 3 and not {"upsert", "upsert-kept", "lines", "wanted", "fold-rows"} & set(left)  # before: a copy of the index each time
    assert sinks.read_chunks(spark, path).select("video_id").distinct().count() == 4


def test_rankings_are_fused_without_their_texts(spark, monkeypatch):
    texts = [words(i) for i in range(30)] + [words(0), words(0), None, None, ""]
    corpus = retrieval.hash_vectors(chunks(spark, texts), kind="double")
    asked = spark.createDataFrame([(q, f"v{q % 3}", words(q, 4)) for q in range(9)], "query_id long, video_id string, question string")
    asked = retrieval.hash_vectors(asked, text="question", kind="double")
    tables = {}
    monkeypatch.setattr(retrieval, "written_once", lambda df, name: (tables.update({name: df}), written_once(df, name))[1])
    got = retrieval.hybrid_retrieve(corpus, asked)
    plain = corpus.select("video_id", "chunk_id", "text")
    dense = retrieval.dense_threshold(retrieval.nearest(corpus, asked, 30, digits=12))
    both = dense.drop("score").selectExpr("*", "0 as list").unionByName(retrieval.bm25_topk(plain, asked, 30).drop("score").selectExpr("*", "1 as list"))
    want = retrieval.rrf_fuse(both.join(plain, ["video_id", "chunk_id"]))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "text" not in tables["fused"].columns  # before: texts were shuffled with every rank


def test_a_stream_of_words_comes_in_batches(spark, tmp_path, monkeypatch):
    rows = [(i, words(i, 40).replace("beta1 ", "beta1. ")) for i in range(60)] + [(100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(str, QUERIES["stream_sentences"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(q_state, "STREAM_FILES", 2)
    before = scratch(spark)
    assert sorted(map(str, QUERIES["stream_sentences"](spark, str(tmp_path)).collect())) == want
    state = next(n for n in scratch(spark) - before if n.startswith("state-"))
    commits = os.listdir(f"{shared_folder(spark)}/cuewright/{state}/commits")
    assert len([c for c in commits if c.isdigit()]) > 3  # before: one batch
