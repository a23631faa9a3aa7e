"""Streams over files, in several deliveries."""

import random

from pyspark.sql import functions as F

from cuewright.operators import runlog, sentences
from cuewright.session import scratch_path
from cuewright.sources import readers, sinks
from cuewright.streaming import streams
from tests.test_sentences import frame, make_words, plain_runs


def deliver(spark, frames):
    path = scratch_path(spark, "in")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sentences_across_deliveries(spark):
    rng = random.Random(8)
    videos = {f"v{k}": make_words(rng, 40) for k in range(4)}
    words = frame(spark, videos)
    end = spark.createDataFrame([(v, 40, None, None, None) for v in videos], words.schema)
    stream = deliver(spark, [words.where("word_idx < 15"), words.where("word_idx >= 15"), end])
    built = streams.stream_sentences(stream, max_words=0)
    out = scratch_path(spark, "out")
    query = built.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = {(r.video_id, r.run_start) for r in spark.read.parquet(out).collect()}
    assert got == {(v, s) for v, line in videos.items() for s in plain_runs(line, 1.5)}
    batch = sentences.soft_split(sentences.sentence_runs(words), max_words=0)
    assert {(r.video_id, r.run_start, r.text) for r in spark.read.parquet(out).collect()} == {
        (r.video_id, r.run_start, r.text) for r in batch.collect()
    }


def test_run_log_with_late_events(spark):
    rows = [("r", 1, "loaded", None), ("r", 3, None, 2.0), ("r", 2, "late", 1.0), ("q", 1, "x", None)]
    frames = [spark.createDataFrame([r], "video_id string, seq long, status string, secs double") for r in rows]
    path = scratch_path(spark, "runs")
    streams.stream_run_log(deliver(spark, frames), path, scratch_path(spark, "cp"), ["status", "secs"]).awaitTermination()
    assert {(r.video_id, r.status, r.secs) for r in spark.read.parquet(path).collect()} == {("r", "late", 2.0), ("q", "x", None)}


def test_session_window_cuts_at_the_gap(spark):
    rows = [(0, 1), (2, 3), (4, 5)]  # gaps of one second; alpha 1 cuts every time, alpha 1.5 never
    df = spark.createDataFrame([("v", a, b) for a, b in rows], "video_id string, a long, b long").select(
        "video_id", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts")
    )
    for alpha, sessions in ((1.0, 3), (1.5, 1)):
        assert streams.stream_pause_sessions(df, alpha).count() == sessions


def test_progress_throttle_in_many_blocks(spark):
    rng = random.Random(9)
    ends = sorted(rng.uniform(0, 130) for _ in range(60))
    rows = spark.createDataFrame([("v", i, e, 100.0) for i, e in enumerate(ends)], "video_id string, pos long, end double, total double")
    want, last = [], -1
    for i, e in enumerate(ends):
        pct = max(0, min(99, int(e * 100 / 100.0)))
        if pct >= last + 2:
            want.append((i, pct))
            last = pct
    for size in (1 << 16, 7):
        got = runlog.progress_throttle(rows, size=size).orderBy("pos").collect()
        assert [(r.pos, r.percent) for r in got] == want


def test_segment_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"text": "a", "start": 1.0, "duration": 2}, 7, {"text": "b"}]')
    (tmp_path / "bad.json").write_text('{"text": "a"}')
    segments, corrupt = readers.read_segment_files(spark, str(tmp_path))
    assert [(r.video_id, r.seg_idx, r.text) for r in segments.orderBy("seg_idx").collect()] == [("good", 0, "a"), ("good", 2, "b")]
    assert [r.video_id for r in corrupt.collect()] == ["bad"]


def test_long_transcripts_are_stored_in_parts(spark):
    rows = spark.createDataFrame([("v", i, f"t{i}", float(i), 1.0) for i in range(25)], "video_id string, seg_idx long, text string, start double, duration double")
    payloads = sinks.transcript_payloads(rows, part_rows=10)
    assert sorted((r.first_idx, len(r.segments)) for r in payloads.collect()) == [(0, 10), (10, 10), (20, 5)]


def test_glossary_file(spark, tmp_path):
    good, broken = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"RAM": " bộ nhớ ", " ": "x",\n "y": ""}')
    broken.write_text('{"RAM": ')
    from cuewright import fixed_values as fv
    from cuewright.operators.catalogue import overlay_glossary

    got = {r.written: r.spoken for r in overlay_glossary(fv.BUILTIN_GLOSSARY, readers.read_glossary(spark, str(good))).collect()}
    assert got == {**fv.BUILTIN_GLOSSARY, "RAM": "bộ nhớ"}
    assert readers.read_glossary(spark, str(broken)).count() == 0


def test_run_log_round_trip(spark):
    path = scratch_path(spark, "log")
    rows = spark.createDataFrame([("a_1", "a", 1, 2.0, None)], "run_id string, video_id string, run_index long, duration_min double, error string")
    sinks.write_run_log(rows, path)
    back = readers.read_run_log(spark, path).first()
    assert (back.run_id, back.run_index, back.duration_min, back.error) == ("a_1", "1", "2.000", None)


def test_index_follows_changed_grown_and_emptied_videos(spark):
    from cuewright.operators import indexing
    from cuewright.session import scratch_path
    from cuewright.sources import sinks

    path = scratch_path(spark, "index-test")
    schema = "video_id string, seg_idx long, start double, end double, text string"
    make = lambda v, texts, at=0: [(v, at + i, float(at + i), at + i + 1.0, t) for i, t in enumerate(texts)]
    run = lambda rows: {r.video_id: r.reason for r in indexing.incremental_index(spark.createDataFrame(rows, schema), path).collect()}
    chunks = lambda: {r.video_id: r.t for r in sinks.read_chunks(spark, path).groupBy("video_id").agg(F.concat_ws("|", F.sort_array(F.collect_list("text"))).alias("t")).collect()}
    one = make("a", ["first line of a"]) + make("b", ["only line of b"]) + make("c", ["c stays"])
    assert run(one) == {"a": "missing", "b": "missing", "c": "missing"}
    assert run(one) == {}
    two = make("a", ["changed line of a"]) + make("b", [" "]) + make("c", ["c stays"]) + make("d", ["new"])
    assert run(two) == {"a": "stale", "b": "stale", "d": "missing"}
    found = chunks()
    assert set(found) == {"a", "c", "d"} and "changed" in found["a"]
    assert run(two) == {}


def test_deliveries_that_split_a_video(spark):
    from cuewright.operators import indexing
    from cuewright.session import scratch_path
    from cuewright.sources import sinks

    path = scratch_path(spark, "deliveries-test")
    schema = "video_id string, seg_idx long, start double, end double, text string"
    part = lambda lo, hi: spark.createDataFrame([("v", i, float(i), i + 1.0, f"line {i}.") for i in range(lo, hi)], schema)
    for number, (lo, hi) in enumerate([(0, 20), (20, 40), (20, 40)]):
        indexing.append_and_index(part(lo, hi), path, number)
    text = " ".join(r.text for r in sinks.read_chunks(spark, path).collect())
    assert all(f"line {i}." in text for i in range(40))
