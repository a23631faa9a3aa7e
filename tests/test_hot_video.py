"""One video with most rows, at the real block size, against plain loops."""

import random

from pyspark.sql import functions as F

from cuewright.operators import chunking, player, segments, sentences, timing, transcripts
from cuewright.plans.blocked import block_window, drop_halo, many_blocks, with_halo
from cuewright.sources import sinks
from tests.test_folds import plain_chunks, plain_groups
from tests.test_sentences import frame as word_frame
from tests.test_sentences import make_words, plain_runs

ROWS = 150_000


def hot_segments(spark):
    rng = random.Random(20)
    t, lines = 0, []
    for _ in range(ROWS):
        t += rng.choice([0, 200, 400, 2000])
        d = rng.choice([500, 1500])
        lines.append(("x" * rng.choice([1, 3, 9, 30]), t / 1000, d / 1000))
        t += d
    videos = {"hot": lines, "small": lines[:50]}
    rows = [(v, i, *line) for v, items in videos.items() for i, line in enumerate(items)]
    df = spark.createDataFrame(rows, "video_id string, seg_idx long, text string, start double, duration double")
    return videos, df.withColumns({"text_vi": F.lit(None).cast("string"), "text_tts": F.lit(None).cast("string")}).repartition(6)


def test_hot_segments(spark):
    videos, df = hot_segments(spark)
    assert many_blocks(df, "seg_idx")
    ended = df.withColumn("end", F.col("start") + F.col("duration"))
    found = chunking.chunk_segments(ended).select("video_id", "segment_start", "segment_end").collect()
    for v, lines in videos.items():
        got = sorted((r.segment_start, r.segment_end) for r in found if r.video_id == v)
        # The loop joins texts again and again; lengths are enough for the same answer.
        assert got == fast_chunks(lines, 900, 2)
        assert fast_chunks(lines[:300], 900, 2) == plain_chunks(lines[:300], 900, 2)

    grouped = segments.merge_segments(df, 20, 0.3).select("video_id", "source_indices").collect()
    for v, lines in videos.items():
        assert sorted(list(r.source_indices) for r in grouped if r.video_id == v) == plain_groups(lines, 20, 0.3)

    ranged = timing.source_range(df).where("video_id = 'hot'").select("seg_idx", "src_end").collect()
    ends = {r.seg_idx: r.src_end for r in ranged}
    assert len(ends) == ROWS
    assert all(ends[i] == videos["hot"][i + 1][1] for i in range(ROWS - 1))

    pieces = transcripts.full_text(df).where("video_id = 'hot'").orderBy("seg_idx").collect()
    whole = " ".join(t for t, _, _ in videos["hot"])
    assert len(pieces) == ROWS and " ".join(r.piece for r in pieces) == whole
    assert all(whole[r.offset :].startswith(r.piece) for r in pieces[:: ROWS // 50])


def test_one_file_per_video_at_every_length(spark, tmp_path):
    n = 70_000
    rows = [("long", i, i * 2.0, i * 2.0 + 1, f"line {i}") for i in range(n)] + [("short", 7, 0.0, 1.0, "größe")]
    cues = spark.createDataFrame(rows, "video_id string, seg_idx long, start double, end double, text string")
    pieces = player._vtt(cues, "seg_idx")
    assert pieces.columns == ["video_id", "seg_idx", "piece", "offset"] and pieces.count() == n + 3
    sinks.write_files(pieces, str(tmp_path / "vtt"), "seg_idx")
    for video, count in (("long", n), ("short", 1)):
        (file,) = (tmp_path / "vtt" / f"video_id={video}").glob("*.txt")
        content = file.read_bytes()
        assert content.startswith(b"WEBVTT\n\n00:00:00.000 --> ") and content.count(b"WEBVTT") == 1 and content.count(b" --> ") == count
        last = pieces.where(f"video_id = '{video}'").orderBy("seg_idx", ascending=False).first()
        assert content[last.offset :] == last.piece.encode() + b"\n"


def fast_chunks(lines, target, overlap):
    out, begin, size, emitted = [], 0, -1, -1
    for i, (text, _, _) in enumerate(lines):
        size += len(text) + 1
        if size >= target:
            out.append((begin, i))
            emitted, begin = i, max(begin, i - overlap + 1)
            size = sum(len(lines[k][0]) + 1 for k in range(begin, i + 1)) - 1
    if emitted < len(lines) - 1:
        out.append((begin, len(lines) - 1))
    return out


def test_hot_words(spark):
    words = make_words(random.Random(21), ROWS)
    found = sentences.sentence_runs(word_frame(spark, {"hot": words, "small": words[:30]}))
    starts = {(r.video_id, r.run_start) for r in found.select("video_id", "run_start").distinct().collect()}
    assert starts == {(v, s) for v, ws in (("hot", words), ("small", words[:30])) for s in plain_runs(ws, 1.5)}
    built = sentences.sentences(word_frame(spark, {"hot": words}))
    assert built.agg(F.sum("n_words")).first()[0] == ROWS


def test_a_missing_row_at_a_block_edge_changes_nothing(spark):
    from cuewright.operators.timing import source_range

    keep = [i for i in range(1, 60) if i not in (16, 17, 32, 47)]
    rows = spark.createDataFrame([("v", i, float(i), 0.5, f"t{i}") for i in keep], "video_id string, seg_idx long, start double, duration double, text string")
    plain = source_range(rows).orderBy("seg_idx").collect()
    ahead = with_halo(rows, "seg_idx", after=1, size=16, many=True)
    window = block_window(["video_id"], "seg_idx", many=True)
    got = drop_halo(ahead.withColumn("next", F.lead("start").over(window))).orderBy("seg_idx").collect()
    assert [r.next for r in got] == [float(i) for i in keep[1:]] + [None]
    assert len(plain) == len(keep)


def test_batches_count_rows_whatever_the_index(spark):
    from cuewright.operators.translation import batch_lines

    keep = [2, 3, 5, 9, 10, 11, 30]
    rows = spark.createDataFrame([("v", i, f"body {i}") for i in keep], "video_id string, seg_idx long, body string")
    for options in ({"batch_size": 3}, {"batch_size": 3, "max_chars": 1000}, {"batch_size": 3, "max_chars": 1000, "size": 4}):
        got = batch_lines(rows, **options).orderBy("seg_idx").collect()
        assert [(r.batch_no, r.line_no) for r in got] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]
