"""Timing, player and frame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.catalog import sql_bits as sb
from cuewright.catalog import views
from cuewright.catalog.registry import SQL_VIEWS, query
from cuewright.operators import chapters, chunking, frames, player, segments, timing
from cuewright.session import scratch_path
from cuewright.sources import sinks

SQL_VIEWS["v_src"] = """
  SELECT *, CASE WHEN e0 <= start THEN start + greatest(duration, 0.5) ELSE e0 END AS src_end FROM (
    SELECT *, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY seg_idx), start + duration) AS e0 FROM v_timed)
"""
SQL_VIEWS["v_pairs"] = """
  SELECT *,
    CASE WHEN n_pb_tts_start IS NOT NULL AND n_pb_tts_end IS NOT NULL THEN n_pb_tts_start WHEN l_pb_tts_start IS NOT NULL THEN l_pb_tts_start
         WHEN n_tts_start IS NOT NULL AND n_tts_end IS NOT NULL THEN n_tts_start WHEN l_tts_start IS NOT NULL THEN l_tts_start END AS sp_start,
    CASE WHEN n_pb_tts_start IS NOT NULL AND n_pb_tts_end IS NOT NULL THEN n_pb_tts_end WHEN l_pb_tts_start IS NOT NULL THEN l_pb_tts_end
         WHEN n_tts_start IS NOT NULL AND n_tts_end IS NOT NULL THEN n_tts_end WHEN l_tts_start IS NOT NULL THEN l_tts_end END AS sp_end,
    coalesce(n_pb_start, l_pb_start) AS pb_start, coalesce(n_pb_end, l_pb_end) AS pb_end FROM v_src
"""
SQL_VIEWS["v_disp"] = """
  SELECT *, CASE WHEN pb_end > pb_start THEN pb_start ELSE start END AS en_start, CASE WHEN pb_end > pb_start THEN pb_end ELSE src_end END AS en_end,
    CASE WHEN sp_end > sp_start THEN sp_start WHEN pb_end > pb_start THEN pb_start ELSE start END AS vi_start,
    CASE WHEN sp_end > sp_start THEN sp_end WHEN pb_end > pb_start THEN pb_end ELSE src_end END AS vi_end FROM v_pairs
"""


@query("timing_precedence", "SELECT video_id, seg_idx, sp_start, sp_end, pb_start, pb_end FROM v_pairs")
def timing_precedence(spark, sf):
    said, played = timing.speech_pair(playback=True), timing.playback_pair()
    return views.timed_segments(spark, sf).select(
        "video_id",
        "seg_idx",
        said["start"].alias("sp_start"),
        said["end"].alias("sp_end"),
        played["start"].alias("pb_start"),
        played["end"].alias("pb_end"),
    )


@query("display_range", "SELECT video_id, seg_idx, vi_start AS disp_start, vi_end AS disp_end FROM v_disp")
def display_range(spark, sf):
    return timing.display_range(views.timed_segments(spark, sf), prefer_speech=True).select(
        "video_id", "seg_idx", "disp_start", "disp_end"
    )


@query("clear_timing", "SELECT video_id, seg_idx, text, start, duration FROM v_timed")
def clear_timing(spark, sf):
    bare = timing.clear_timing(views.timed_segments(spark, sf))
    return bare.drop("conv_id", "role", "text_vi", "text_tts", "dur_ms", "start_ms", "m")


@query(
    "migrate_timing",
    """SELECT video_id, seg_idx, CASE WHEN n_tts_start IS NOT NULL AND n_tts_end IS NOT NULL THEN n_tts_start ELSE l_tts_start END AS tts_start,
         CASE WHEN n_tts_start IS NOT NULL AND n_tts_end IS NOT NULL THEN n_tts_end ELSE l_tts_end END AS tts_end,
         coalesce(n_pb_start, l_pb_start) AS pb_start, coalesce(n_pb_end, l_pb_end) AS pb_end,
         CASE WHEN n_pb_tts_start IS NOT NULL AND n_pb_tts_end IS NOT NULL THEN n_pb_tts_start ELSE l_pb_tts_start END AS pb_tts_start,
         CASE WHEN n_pb_tts_start IS NOT NULL AND n_pb_tts_end IS NOT NULL THEN n_pb_tts_end ELSE l_pb_tts_end END AS pb_tts_end FROM v_timed""",
)
def migrate_timing(spark, sf):
    moved = timing.migrate_timing(views.timed_segments(spark, sf))
    return moved.select(
        "video_id",
        "seg_idx",
        F.col("tts.start").alias("tts_start"),
        F.col("tts.end").alias("tts_end"),
        F.col("playback.start").alias("pb_start"),
        F.col("playback.end").alias("pb_end"),
        F.col("playback.tts_start").alias("pb_tts_start"),
        F.col("playback.tts_end").alias("pb_tts_end"),
    )


@query(
    "playback_timing",
    """SELECT video_id, seg_idx, round(start / 1.25::DOUBLE, 3) AS start, round(src_end / 1.25::DOUBLE, 3) AS "end", round((src_end - start) / 1.25::DOUBLE, 3) AS duration,
         CASE WHEN te IS NOT NULL THEN round(n_tts_start / 1.25::DOUBLE, 3) END AS tts_start, round(te / 1.25::DOUBLE, 3) AS tts_end,
         round((te - n_tts_start) / 1.25::DOUBLE, 3) AS tts_duration
       FROM (SELECT *, CASE WHEN n_tts_end <= n_tts_start THEN n_tts_start + greatest((dur_ms - dur_ms % 7) / 1000.0::DOUBLE, 0.2) ELSE n_tts_end END AS te FROM v_src)""",
)
def playback_timing(spark, sf):
    fields = "start end duration tts_start tts_end tts_duration".split()
    return timing.playback_timing(views.timed_segments(spark, sf), 1.25).select(
        "video_id", "seg_idx", *[F.col(f"playback.{f}").alias(f) for f in fields]
    )


# ---- synthesis events: three lines each, the next line overlaps ----------------------------------
SQL_VIEWS["v_synth"] = """
  SELECT video_id, seg_idx // 3 AS event_idx, list_concat(list(seg_idx ORDER BY seg_idx), [max(seg_idx) + 1, 999999]) AS source_indices,
         min(start) + 0.1 AS start, CASE WHEN (seg_idx // 3) % 3 = 2 THEN 0.0 ELSE sum(dur_ms) * 9 / 10000.0::DOUBLE END AS speech
  FROM v_segments GROUP BY video_id, seg_idx // 3
"""


def synth_events(spark, sf):
    group = F.floor(F.col("seg_idx") / 3).cast("long")
    members = F.sort_array(F.collect_list("seg_idx"))
    return (
        views.segments(spark, sf)
        .groupBy("video_id", group.alias("event_idx"))
        .agg(
            F.concat(members, F.array(F.max("seg_idx") + 1, F.lit(999999).cast("long"))).alias("source_indices"),
            (F.min("start") + 0.1).alias("start"),
            (F.sum("dur_ms") * 9 / 10000.0).alias("_speech"),
        )
        .select(
            "video_id",
            "event_idx",
            "source_indices",
            "start",
            F.when(F.col("event_idx") % 3 == 2, 0.0).otherwise(F.col("_speech")).alias("speech_duration"),
            F.when(F.col("event_idx") % 2 == 0, F.array(F.lit("fast"), F.lit("slow"))).otherwise(F.array(F.lit("fast"))).alias("fit_warnings"),
        )
    )


SQL_VIEWS["v_members"] = """
  SELECT e.video_id, e.event_idx, ord, i AS seg_idx, e.start AS event_start, speech, s.start AS src_start, s.src_end, greatest(0.0, s.src_end - s.start) AS target,
    greatest(1, length(coalesce(nullif(s.text_vi, ''), nullif(s.text_tts, ''), s.text))) AS weight
  FROM (SELECT *, unnest(source_indices) AS i, unnest(range(len(source_indices))) AS ord FROM v_synth) e
  JOIN v_src s ON s.video_id = e.video_id AND s.seg_idx = e.i
"""
SQL_VIEWS["v_alloc_a"] = """
  SELECT video_id, seg_idx, event_idx, ord, t, CASE WHEN e <= t THEN t + greatest(target, 0.2) ELSE e END AS e, src_start, src_end, target FROM (
    SELECT *, least(src_end, t + greatest(CASE WHEN members = 1 THEN speech WHEN speech > 0 THEN speech * weight / total ELSE target END, 0.2)) AS e FROM (
      SELECT *, greatest(src_start, least(event_start, src_end)) AS t, sum(weight) OVER w AS total, count(*) OVER w AS members
      FROM v_members WINDOW w AS (PARTITION BY video_id, event_idx)))
"""
SQL_VIEWS["v_alloc_b"] = """
  SELECT video_id, seg_idx, event_idx, ord, t, CASE WHEN e <= t THEN t + greatest(target, 0.2) ELSE e END AS e, src_start, src_end, target FROM (
    SELECT *, CASE WHEN speech > 0 THEN event_start + speech * done / total ELSE event_start + silent END AS t,
      CASE WHEN speech <= 0 THEN event_start + silent WHEN place = members THEN event_start + speech
           ELSE event_start + speech * (done + weight) / total END AS e FROM (
      SELECT *, sum(weight) OVER w AS total, count(*) OVER w AS members, row_number() OVER o AS place,
        coalesce(sum(weight) OVER b, 0) AS done, coalesce(sum(greatest(target, 0.2)) OVER b, 0.0) AS silent
      FROM v_members WINDOW w AS (PARTITION BY video_id, event_idx), o AS (PARTITION BY video_id, event_idx ORDER BY ord),
        b AS (PARTITION BY video_id, event_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
"""
_ALLOC = """SELECT video_id, seg_idx, event_idx, round(t, 3) AS start, round(e, 3) AS "end", round(e - t, 3) AS duration,
     round(src_start, 3) AS slot_start, round(src_end, 3) AS slot_end, round(target, 3) AS target_duration
   FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY event_idx DESC, ord DESC) AS r FROM {view}) WHERE r = 1"""
_BLOCK = "start end duration slot_start slot_end target_duration".split()


def _allocated(spark, sf, engine):
    found = timing.allocate_timing(views.segments(spark, sf), synth_events(spark, sf), engine)
    return found.select("video_id", "seg_idx", "event_idx", *[F.col(f"tts.{c}").alias(c) for c in _BLOCK])


@query("allocate_timing", _ALLOC.format(view="v_alloc_a"))
def allocate_timing(spark, sf):
    return _allocated(spark, sf, "supertonic")


@query("allocate_timing_running", _ALLOC.format(view="v_alloc_b"))
def allocate_timing_running(spark, sf):
    return _allocated(spark, sf, "omnivoice")


@query(
    "attach_timings",
    f"""SELECT s.video_id, s.seg_idx, a.start AS tts_start, a."end" AS tts_end,
         array_to_string(list_distinct_ordered, ',') AS warnings
       FROM v_segments s LEFT JOIN ({_ALLOC.format(view='v_alloc_a')}) a USING (video_id, seg_idx)
       LEFT JOIN (SELECT video_id, seg_idx, CASE WHEN bool_or(event_idx % 2 = 0) THEN ['fast', 'slow'] ELSE ['fast'] END AS list_distinct_ordered
                  FROM v_members GROUP BY ALL) n USING (video_id, seg_idx)""",
)
def attach_timings(spark, sf):
    plain = views.segments(spark, sf).withColumn("warnings", F.lit(None).cast("array<string>"))
    attached = timing.attach_timings(plain, synth_events(spark, sf))
    return attached.select(
        "video_id",
        "seg_idx",
        F.col("tts.start").alias("tts_start"),
        F.col("tts.end").alias("tts_end"),
        F.array_join("warnings", ",").alias("warnings"),
    )


# ---- tracks ------------------------------------------------------------------------------------
_CUE = "{start} || ' --> ' || {end} || chr(10) || {text} || chr(10)"


_PIECES = """SELECT *, coalesce(sum(strlen(piece) + 1) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
         SELECT {keys}, {order}, cue AS piece FROM ({cues}) UNION ALL SELECT DISTINCT {keys}, -1::BIGINT, 'WEBVTT' || chr(10) FROM ({cues}))"""
_CUES = f"""SELECT video_id, 'vi' AS lang, seg_idx, {_CUE.format(start=sb.cue_time('vi_start'), end=sb.cue_time('e'), text='t')} AS cue FROM (
           SELECT *, CASE WHEN vi_end <= vi_start THEN vi_start + greatest(duration, 0.5) ELSE vi_end END AS e,
             {sb.strip("replace(CASE WHEN text_vi <> '' THEN text_vi ELSE coalesce(text_tts, '') END, chr(10), ' ')")} AS t FROM v_disp) WHERE t <> ''
       UNION ALL
       SELECT video_id, 'en' AS lang, seg_idx, {_CUE.format(start=sb.cue_time('en_start'), end=sb.cue_time('e'), text='t')} AS cue FROM (
           SELECT *, CASE WHEN en_end <= en_start THEN en_start + greatest(duration, 0.5) ELSE en_end END AS e,
             {sb.strip("replace(text, chr(10), ' ')")} AS t FROM v_disp) WHERE t <> ''"""


@query("export_vtt", _PIECES.format(keys="video_id, lang", order="seg_idx", cues=_CUES))
def export_vtt(spark, sf):
    timed = views.timed_segments(spark, sf)
    vi, en = (player.export_vtt(timed, lang).withColumn("lang", F.lit(lang)) for lang in ("vi", "en"))
    return vi.unionByName(en)


_CHAPTER_CUES = f"""SELECT video_id, "index", {_CUE.format(start=sb.cue_time('start'), end=sb.cue_time('"end"'), text='t')} AS cue
        FROM (SELECT *, bool_and(t <> '') OVER (PARTITION BY video_id) AS ok FROM (
          SELECT *, CASE WHEN length(title) % 9 = 0 THEN '' ELSE 'vi ' || title END AS t FROM v_chapters)) WHERE ok"""


@query("export_chapter_vtt", _PIECES.format(keys="video_id", order='"index"', cues=_CHAPTER_CUES))
def export_chapter_vtt(spark, sf):
    found = chapters.normalize_chapters(views.raw_chapters(spark, sf))
    title = F.when(F.length("title") % 9 == 0, " ").otherwise(F.concat(F.lit("vi  "), F.col("title")))
    return player.export_chapter_vtt(found.withColumn("title_vi", title))


@query(
    "subtitle_files",
    f"""SELECT video_id, lang, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) ORDER BY seg_idx) || chr(10) AS content FROM ({_CUES}) GROUP BY video_id, lang""",
)
def subtitle_files(spark, sf):
    """One subtitle file per video and language, written and read back whole."""
    path = scratch_path(spark, "subtitles")
    sinks.write_files(export_vtt(spark, sf), path, "seg_idx", keys=("video_id", "lang"))
    return spark.read.text(path, wholetext=True).select("video_id", "lang", F.col("value").alias("content"))


@query(
    "reader_rows",
    f"""SELECT video_id, seg_idx AS "index", vi_start AS start, CASE WHEN vi_end <= vi_start THEN vi_start + greatest(duration, 0.5) ELSE vi_end END AS "end", duration,
         {sb.strip("replace(text, chr(10), ' ')")} AS en, CASE WHEN text_vi <> '' THEN {sb.strip('text_vi')} ELSE {sb.strip("coalesce(text_tts, '')")} END AS vi,
         {sb.strip("coalesce(nullif(text_tts, ''), nullif(text_vi, ''), '')")} AS tts_text, eng AS tts_engine,
         CASE WHEN m = 0 THEN 32 WHEN eng = 'omnivoice' THEN 48 ELSE 8 END AS num_step, eng IS NOT NULL AS can_regenerate
       FROM (SELECT *, CASE WHEN m IN (0, 1, 2) THEN CASE WHEN seg_idx % 2 = 0 THEN 'omnivoice' ELSE 'supertonic' END END AS eng FROM v_disp)""",
)
def reader_rows(spark, sf):
    return player.reader_rows(views.timed_segments(spark, sf))


@query(
    "active_segment",
    """SELECT p.probe_id, p.video_id, p.t, coalesce(max(s.seg_idx), -1) AS active_idx FROM (
         SELECT event_id AS probe_id, 'v' || user_id AS video_id, ((epoch_us(ts) // 1000) % 60000) / 1000.0::DOUBLE AS t FROM events) p
       LEFT JOIN v_segments s ON s.video_id = p.video_id AND s.start <= p.t GROUP BY ALL""",
)
def active_segment(spark, sf):
    probes = views.table(spark, sf, "events").select(
        F.col("event_id").alias("probe_id"),
        F.concat(F.lit("v"), F.col("user_id")).alias("video_id"),
        (F.floor(views.micros("ts") / 1000) % 60000 / 1000.0).alias("t"),
    )
    return player.active_segment(views.segments(spark, sf), probes)


@query(
    "history_window",
    f"""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr({sb.squeeze('c')}, 1, CASE role WHEN 'assistant' THEN 1200 ELSE 800 END), chr(10) ORDER BY turn) AS history FROM (
         SELECT *, substr({sb.strip('text')}, 1, CASE role WHEN 'assistant' THEN 1200 ELSE 800 END) AS c FROM (
           SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND role IN ('user', 'assistant'))
       WHERE c <> '' GROUP BY conv_id""",
)
def history_window(spark, sf):
    return player.format_history(player.request_history(views.table(spark, sf, "conversations")))


@query(
    "history_pairs",
    """SELECT conv_id, turn, pos, role, text FROM (
         SELECT conv_id, turn, 0 AS pos, 'user' AS role, q AS text, r FROM p UNION ALL SELECT conv_id, turn, 1, 'assistant', substr(a, 1, 1200), r FROM p)
       WHERE r <= 3 AND trim(text) <> ''""".replace(
        "FROM p", "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM v_exchanges WHERE a <> '' AND turn % 5 <> 4)"
    ),
)
def history_pairs(spark, sf):
    pair = F.floor(F.col("turn") / 2).cast("long")
    said = views.table(spark, sf, "conversations").withColumn("turn_no", pair)
    exchanges = (
        said.groupBy("conv_id", F.col("turn_no").alias("turn"))
        .agg(
            F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("question"),
            F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("answer"),
        )
        .withColumns({"pending": F.col("turn") % 5 == 4, "error": F.lit(None).cast("string")})
    )
    return player.answered_pairs(exchanges)


SQL_VIEWS["v_exchanges"] = """
  SELECT conv_id, turn // 2 AS turn, coalesce(max(CASE WHEN turn % 2 = 0 THEN text END), '') AS q, max(CASE WHEN turn % 2 = 1 THEN text END) AS a
  FROM conversations GROUP BY conv_id, turn // 2
"""


# ---- grouping, samples, chunks ---------------------------------------------------------------------
def line_segments(spark, sf):
    """Document lines as segments; every line keeps its dense index."""
    return views.lines(spark, sf).select(
        "video_id",
        F.col("line_idx").alias("seg_idx"),
        F.col("line").alias("text"),
        F.when(F.col("line_idx") % 3 == 0, F.concat(F.lit("Dòng "), F.col("line_idx"))).alias("text_vi"),
        F.when(F.col("line_idx") % 4 == 0, F.concat(F.lit("dòng "), F.col("line_idx"))).alias("text_tts"),
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("dur_ms") / 1000.0).alias("duration"),
    )


@query("merge_segments")
def merge_segments(spark, sf):
    merged = segments.merge_segments(line_segments(spark, sf), 200, 0.6)
    return merged.select(
        "video_id",
        "group_start",
        F.array_join(F.transform("source_indices", lambda x: x.cast("string")), ",").alias("source_indices"),
        F.array_join("source_texts", "|").alias("source_texts"),
        "text_tts",
        F.round("start", 3).alias("start"),
        F.round("duration", 3).alias("duration"),
    )


@query("reference_window")
def reference_window(spark, sf):
    return segments.reference_window(line_segments(spark, sf))


@query("chunk_segments")
def chunk_segments(spark, sf):
    return chunks(spark, sf)


def chunks(spark, sf):
    """Chunks of all conversations and all documents' lines."""
    ranged = timing.display_range(views.timed_segments(spark, sf), prefer_speech=True)
    spoken = chunking.retrieval_segments(ranged)
    lines = line_segments(spark, sf).select(
        "video_id", "seg_idx", "start", (F.col("start") + F.col("duration")).alias("end"), "text"
    )
    return chunking.chunk_segments(spoken.unionByName(lines))


@query("chunk_documents")
def chunk_documents(spark, sf):
    return chunking.chunk_documents(views.table(spark, sf, "documents"), "doc_id")


# ---- frames ------------------------------------------------------------------------------------
RATE = 200
SQL_VIEWS["v_frames"] = """
  SELECT clip_id, i // 4 AS frame_idx, sqrt(avg(x * x) + 1e-9) AS rms FROM v_samples GROUP BY clip_id, i // 4 HAVING count(*) = 4
"""
SQL_VIEWS["v_silences"] = """
  SELECT clip_id, min(frame_idx) * 4 AS start, (max(frame_idx) + 1) * 4 AS "end" FROM (
    SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM (
      SELECT *, rms < greatest(max(rms) OVER (PARTITION BY clip_id), 1e-6) * pow(10, -35.0::DOUBLE / 20) AS quiet FROM v_frames) WHERE quiet)
  GROUP BY clip_id, g
"""


@query("frame_rms", "SELECT clip_id, frame_idx, round(rms, 6) AS rms FROM v_frames")
def frame_rms(spark, sf):
    return frames.frame_rms(views.samples(spark, sf), RATE).withColumn("rms", F.round("rms", 6))


@query("silence_runs", "SELECT * FROM v_silences")
def silence_runs(spark, sf):
    return frames.silence_runs(views.samples(spark, sf), RATE)


@query(
    "silence_trim_plan",
    """SELECT clip_id, start, "end", trimmable, round_even(least(n - target, total) * trimmable / total::DOUBLE, 0)::BIGINT AS cut FROM (
         SELECT *, sum(trimmable) OVER (PARTITION BY clip_id)::BIGINT AS total FROM (
           SELECT r.*, c.n, c.target, greatest(0, ("end" - start) - CASE WHEN rk <= CASE WHEN n_runs > 1 THEN round_even(n_runs * 0.3::DOUBLE, 0) ELSE 0 END THEN 24 ELSE 8 END)::BIGINT AS trimmable FROM (
             SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY "end" - start DESC, start) AS rk, count(*) OVER (PARTITION BY clip_id) AS n_runs FROM v_silences) r
           JOIN (SELECT clip_id, count(*) AS n, count(*) * 9 // 10 AS target FROM v_samples GROUP BY clip_id) c USING (clip_id)))
       WHERE total > 0 AND n > target""",
)
def silence_trim_plan(spark, sf):
    samples = views.samples(spark, sf)
    clips = samples.groupBy("clip_id").agg(F.count("*").alias("n_samples")).withColumn(
        "target", F.floor(F.col("n_samples") * 9 / 10).cast("long")
    )
    return frames.silence_trim_plan(frames.silence_runs(samples, RATE), clips, RATE)


@query(
    "active_range",
    """SELECT clip_id, CASE WHEN f IS NULL THEN 0 ELSE greatest(0, least(f * 4 - 8, n)) END::BIGINT AS start,
         CASE WHEN f IS NULL THEN n ELSE least(n, greatest(greatest(0, least(f * 4 - 8, n)) + 4, (l + 1) * 4 + 36)) END::BIGINT AS "end" FROM (
       SELECT c.clip_id, c.n, min(frame_idx) AS f, max(frame_idx) AS l FROM (SELECT clip_id, count(*) AS n, max(abs(x)) AS peak FROM v_samples GROUP BY clip_id) c
       LEFT JOIN v_frames r ON r.clip_id = c.clip_id AND r.rms >= c.peak * pow(10, -45.0::DOUBLE / 20) AND c.peak > 1e-6 GROUP BY ALL)""",
)
def active_range(spark, sf):
    return frames.active_range(views.samples(spark, sf), RATE)
