"""Sentence rebuild against plain sequential loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import sentences as snt
from cuewright.plans import blocked

WORDS = ["alpha", "beta,", "end.", "and", "wow!", "because", "x-", "mid", "so", "ok…", "tail"]


def make_words(rng, n):
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 0, 100, 100, 1500, 1700])
        d = rng.choice([100, 200])
        out.append((i, rng.choice(WORDS), t / 1000, (t + d) / 1000))
        t += d
    return out


def plain_runs(words, alpha):
    starts, i = [], 0
    while i < len(words):
        starts.append(i)
        j = i + 1
        while j < len(words):
            if words[j][2] - words[j - 1][3] >= alpha:
                break
            j += 1
            if words[j - 1][1][-1] in ".!?…":
                break
        i = j
    return starts


def plain_split(words, i, j, limit):
    if j - i <= limit:
        return [(i, j)]
    soft = [m + 1 for m in range(i + 1, j - 1) if words[m][1][-1] in ",;-"]
    conj = [m for m in range(i + 2, j - 1) if words[m][1].strip(".,;-").lower() in snt.fv.CONJUNCTIONS]
    for points in (soft, conj):
        if points:
            at = min(points, key=lambda c: (abs(2 * c - i - j), c))
            return plain_split(words, i, at, limit) + plain_split(words, at, j, limit)
    return [(i, j)]


def plain_merge(words, ranges, least):
    ranges = list(ranges)
    while len(ranges) > 1:
        for k, (i, j) in enumerate(ranges):
            if j - i < least and words[j - 1][1][-1] not in ".!?…":
                break
        else:
            return ranges
        before = words[i][2] - words[ranges[k - 1][1] - 1][3] if k else float("inf")
        after = words[ranges[k + 1][0]][2] - words[j - 1][3] if k + 1 < len(ranges) else float("inf")
        if before <= after:
            ranges[k - 1 : k + 1] = [(ranges[k - 1][0], j)]
        else:
            ranges[k : k + 2] = [(i, ranges[k + 1][1])]
    return ranges


def frame(spark, videos):
    rows = [(v, *w) for v, words in videos.items() for w in words]
    return spark.createDataFrame(rows, "video_id string, word_idx long, word string, start double, end double").repartition(3)


@pytest.fixture(params=["one block", "many blocks"])
def small_blocks(request, monkeypatch, spark):
    """Both plans; the second also with Arrow batches that end inside islands."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if request.param == "many blocks" else 10000)
    if request.param == "many blocks":
        for name in ("with_halo", "running", "many_blocks", "block_of"):
            fn = getattr(blocked, name)
            if "size" in fn.__code__.co_varnames[: fn.__code__.co_argcount]:
                defaults = list(fn.__defaults__)
                monkeypatch.setattr(fn, "__defaults__", tuple(8 if d == 1 << 16 else d for d in defaults))
        monkeypatch.setattr(snt, "BLOCK_ROWS", 8)
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_all_passes_match_loops(spark, small_blocks):
    rng = random.Random(7)
    videos = {f"v{k}": make_words(rng, rng.choice([1, 2, 5, 30, 60])) for k in range(40)}
    got = {
        (r.video_id, r.run_start): (r.n_words, r.text)
        for r in snt.sentences(frame(spark, videos), alpha=1.5, max_words=6, min_words=4).collect()
    }
    want = {}
    for v, words in videos.items():
        starts = plain_runs(words, 1.5) + [len(words)]
        ranges = [p for a, b in zip(starts, starts[1:]) for p in plain_split(words, a, b, 6)]
        for i, j in plain_merge(words, ranges, 4):
            want[(v, i)] = (j - i, " ".join(w[1] for w in words[i:j]))
    assert got == want


def test_run_starts_match_loop(spark, small_blocks):
    rng = random.Random(11)
    videos = {f"v{k}": make_words(rng, 50) for k in range(30)}
    rows = snt.sentence_runs(frame(spark, videos)).select("video_id", "run_start").distinct().collect()
    assert {(r.video_id, r.run_start) for r in rows} == {
        (v, s) for v, words in videos.items() for s in plain_runs(words, 1.5)
    }


def test_oversized_runs_are_cut_by_aggregates(spark):
    rng = random.Random(3)
    words = [(i, rng.choice(["a", "b,", "and", "c", "d;"]), i * 0.1, i * 0.1 + 0.1) for i in range(300)]
    runs = snt.sentence_runs(frame(spark, {"v": words}))
    cut = snt.cut_oversized_runs(runs, ["video_id"], max_words=6, limit=20)
    split = snt.soft_split(cut, max_words=6)
    got = sorted((r.run_start, r.run_start + r.n_words) for r in split.collect())
    assert got == plain_split(words, 0, 300, 6)


def pinned(spark, words, **params):
    rows = snt.sentences(frame(spark, {"v": [(i, *w) for i, w in enumerate(words)]}), **params).orderBy("run_start").collect()
    return [(r.text, round(r.start, 3), round(r.duration, 3)) for r in rows]


def test_pinned_sentence_end(spark):
    words = [("Hello,", 0.0, 0.3), ("there.", 0.3, 0.6), ("How", 0.6, 0.8), ("are", 0.8, 0.9), ("you?", 0.9, 1.1)]
    got = pinned(spark, words, alpha=0.02, max_words=16, min_words=1)
    assert got == [("Hello, there.", 0.0, 0.6), ("How are you?", 0.6, 0.5)]


def test_pinned_soft_split(spark):
    words = [(f"w{i}" + ("," if i in (4, 9) else ""), i / 10, (i + 1) / 10) for i in range(14)]
    got = pinned(spark, words, alpha=0.5, max_words=8, min_words=1)
    assert [t.split()[0] for t, _, _ in got] == ["w0", "w5", "w10"]
    words = [("because" if i == 5 else f"w{i}", i / 10, (i + 1) / 10) for i in range(10)]
    assert [t.split()[0] for t, _, _ in pinned(spark, words, alpha=0.5, max_words=6, min_words=1)] == ["w0", "because"]


def test_pinned_short_merge(spark):
    words = [("one", 0.0, 0.1), ("two", 0.1, 0.2), ("Solo", 0.3, 0.4), ("three", 0.7, 0.8), ("four", 0.8, 0.9)]
    got = pinned(spark, words, alpha=0.05, max_words=16, min_words=2)
    assert [t for t, _, _ in got] == ["one two Solo", "three four"]


def test_barrier_segment_passes_through(spark):
    schema = "video_id string, seg_idx long, text string, start double, end double, words array<struct<word string, start double, end double>>"
    rows = [
        ("v", 0, "a b.", 0.0, 1.0, [("a", 0.0, 0.5), ("b.", 0.5, 1.0)]),
        ("v", 1, "whole", 1.0, 2.0, None),
        ("v", 2, "c d.", 2.0, 3.0, [("c", 2.0, 2.5), ("d.", 2.5, 3.0)]),
    ]
    words, whole = snt.flatten_recogniser(spark.createDataFrame(rows, schema))
    built = snt.sentences(words, keys=("video_id", "island"))
    texts = [r.text for r in built.select("start", "text").union(whole.select("start", "text")).orderBy("start").collect()]
    assert texts == ["a b.", "whole", "c d."]
    assert [r.word_idx for r in words.orderBy("word_idx").select(F.col("word_idx")).collect()] == [0, 1, 2, 3]
