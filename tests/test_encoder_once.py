"""The default encoder: plain counts, and each text encoded once."""

import hashlib

import numpy as np

from cuewright.catalog import q_retrieval
from cuewright.operators import retrieval

TEXTS = ["the cat the hat", " mèo và\tchó\n", "", "   ", None, "a" * 50]


def plain(text):
    counts = np.zeros(256)
    for word in (text or "").split():
        counts[hashlib.md5(word.encode()).digest()[0]] += 1
    return counts / (np.sqrt((counts * counts).sum()) or 1.0)


def test_vectors_are_counts_of_first_bytes(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for kind, number in (("double", np.float64), ("float", np.float32)):
        got = retrieval.hash_vectors(df, kind=kind)
        assert dict(got.dtypes)["vec"] == f"array<{kind}>"
        for row in got.collect():
            assert np.array_equal(np.array(row.vec, number), plain(row.text).astype(number))


def test_forgotten_words_count_the_same():
    got = retrieval.term_shares(TEXTS, retrieval.FirstBytes(most=1))
    assert np.array_equal(got, np.stack([plain(t) for t in TEXTS]))


def test_the_query_encodes_once(spark, monkeypatch):
    rows = [("v", i, t) for i, t in enumerate(TEXTS)]
    monkeypatch.setattr(q_retrieval, "all_chunks", lambda *_: spark.createDataFrame(rows, "video_id string, chunk_pos long, text string"))
    found = q_retrieval.embed_chunks(spark, "")
    assert found._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.chunk_pos, r.place) for r in found.collect()} == {(i, p) for i, t in enumerate(TEXTS) for p in np.flatnonzero(plain(t))}
