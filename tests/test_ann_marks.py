"""Approximate search where buckets are wide: vectors meet once, with the same neighbours."""

import random

from cuewright.operators import retrieval


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


def test_wide_buckets_meet_once(spark, monkeypatch):
    rng = random.Random(5)
    points = [(video, i, [rng.gauss(0, 0.3) for _ in range(8)]) for video, n in (("v", 90), ("w", 7)) for i in range(1000 * (video == "w"), 1000 * (video == "w") + n)]
    chunks = spark.createDataFrame(points, "video_id string, chunk_id long, vec array<float>")
    queries, met, nearest = chunks.withColumnRenamed("chunk_id", "query_id"), [], retrieval.nearest

    def counted(left, right, *args, **options):
        met.append(left.count())
        return nearest(left, right, *args, **options)

    monkeypatch.setattr(retrieval, "nearest", counted)
    for bucket in (1.0, 0.4):
        once = rows(retrieval.ann_topk(chunks, queries, 6, bucket=bucket))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "_products", lambda left, right, keys: len(keys) == 1)  # bucket by bucket
            assert rows(retrieval.ann_topk(chunks, queries, 6, bucket=bucket)) == once
    assert met[:2] == [97, 97 * 8]


def test_ids_that_come_twice_take_one_place(spark, monkeypatch):
    rng = random.Random(7)
    points = [("v", i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(40)]
    chunks = spark.createDataFrame(points + points[::2], "video_id string, chunk_id long, vec array<float>")
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    once = rows(retrieval.ann_topk(chunks, queries, 6))
    assert len({r[::2] for r in once}) == len(once)
    monkeypatch.setattr(retrieval, "_products", lambda left, right, keys: len(keys) == 1)
    assert rows(retrieval.ann_topk(chunks, queries, 6)) == once


def test_narrow_buckets_stay_buckets(spark, monkeypatch):
    rng = random.Random(6)
    points = [("v", i, [rng.gauss(0, 3) for _ in range(8)]) for i in range(60)]
    chunks = spark.createDataFrame(points, "video_id string, chunk_id long, vec array<float>")
    met = []
    monkeypatch.setattr(retrieval, "nearest", lambda left, *args, **options: met.append(left.count()))
    retrieval.ann_topk(chunks, chunks.withColumnRenamed("chunk_id", "query_id"), 6, bucket=0.05)
    assert met == [60 * 8]
