"""Sequence operators: sentences, captions, chapters, transcript-wide results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.catalog import sql_bits as sb
from cuewright.catalog import views
from cuewright.catalog.registry import SQL_VIEWS, query
from cuewright.operators import captions, chapters, sentences, timing, transcripts

SQL_VIEWS["v_word_flags"] = """
  SELECT *, coalesce(start - lag("end") OVER w >= 1.5, true) AS g,
         coalesce(right(lag(word) OVER w, 1) IN ('.', '!', '?', '…'), false) AS pe
  FROM v_words WINDOW w AS (PARTITION BY video_id ORDER BY word_idx)
"""
SQL_VIEWS["v_runs"] = """
  SELECT video_id, word_idx, word, start, "end",
         max(CASE WHEN kg <> ((word_idx - k) % 2 = 1) THEN word_idx END) OVER (
           PARTITION BY video_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS run_start
  FROM (SELECT *, last_value(CASE WHEN g OR NOT pe THEN g END IGNORE NULLS) OVER w AS kg,
               max(CASE WHEN g OR NOT pe THEN word_idx END) OVER w AS k
        FROM v_word_flags WINDOW w AS (PARTITION BY video_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING))
"""


@query("sentence_runs", "SELECT video_id, word_idx, run_start FROM v_runs")
def sentence_runs(spark, sf):
    return sentences.sentence_runs(views.words(spark, sf), many=views.many_words(spark, sf)).select("video_id", "word_idx", "run_start")


@query("soft_split")
def soft_split(spark, sf):
    many = views.many_words(spark, sf)
    return sentences.soft_split(sentences.sentence_runs(views.words(spark, sf), many=many), many=many)


@query("merge_short")
def merge_short(spark, sf):
    many = views.many_words(spark, sf)
    runs = sentences.soft_split(sentences.sentence_runs(views.words(spark, sf), many=many), max_words=0, many=many)
    return sentences.merge_short(runs, many=many)


@query("sentences")
def all_sentences(spark, sf):
    return sentences.sentences(views.words(spark, sf), many=views.many_words(spark, sf))


# ---- recogniser segments: document lines with nested words -----------------------------------------
SQL_VIEWS["v_recogniser"] = """
  SELECT video_id, line_idx AS seg_idx, line AS text, start_ms / 1000.0::DOUBLE AS start,
         CASE WHEN line_idx % 7 <> 6 THEN (start_ms + dur_ms) / 1000.0::DOUBLE END AS "end", line_idx % 9 = 4 AS no_words, start_ms,
         regexp_split_to_array(line, '\\s+') AS toks
  FROM v_lines
"""


def recogniser(spark, sf):
    """Lines with nested timed words; offsets come from a window inside one line.

    A line's own columns travel with its first token, so that lines and words need no join. Lines that name no video have no words.
    """
    spoken = F.when((F.col("line_idx") % 9 != 4) & F.col("video_id").isNotNull(), F.col("line"))
    line = Window.partitionBy("video_id", "line_idx")
    before = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct("line", "start_ms", "dur_ms"))
    tokens = (
        views.lines(spark, sf)
        .withColumn("_apart", F.when(F.col("video_id").isNull(), F.xxhash64("line", "start_ms")))
        .select("*", F.posexplode_outer(F.split(spoken, r"\s+")).alias("pos", "word"))
        .select("video_id", "line_idx", "_apart", "start_ms", "pos", "word", own.alias("own"))
        .withColumn("begin", F.col("start_ms") + 50 * F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))
    )
    timed = F.struct(
        "pos",
        "word",
        (F.col("begin") / 1000.0).alias("start"),
        ((F.col("begin") + 50 * F.length("word")) / 1000.0).alias("end"),
    )
    words = F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), timed)))
    gathered = tokens.groupBy("video_id", "line_idx", "_apart").agg(
        F.collect_list("own").alias("owns"), F.when(F.count("word") > 0, words).alias("words")
    )
    return gathered.select("video_id", "line_idx", "words", F.explode("owns").alias("l")).select(
        "video_id",
        F.col("line_idx").alias("seg_idx"),
        F.col("l.line").alias("text"),
        (F.col("l.start_ms") / 1000.0).alias("start"),
        F.when(F.col("line_idx") % 7 != 6, (F.col("l.start_ms") + F.col("l.dur_ms")) / 1000.0).alias("end"),
        "words",
    )


@query(
    "scan_words",
    f"""SELECT video_id, (SELECT count(*) FROM v_recogniser b WHERE b.video_id = w.video_id AND b.no_words
                AND {sb.strip('b.text')} <> '' AND b.seg_idx < w.seg_idx)::BIGINT AS island,
         row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, pos) - 1 AS word_idx, word,
         (start_ms + off) / 1000.0::DOUBLE AS start, (start_ms + off + 50 * length(word)) / 1000.0::DOUBLE AS "end"
       FROM (SELECT *, (50 * (coalesce(sum(length(word) + 1) OVER (PARTITION BY video_id, seg_idx ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS off
             FROM (SELECT video_id, seg_idx, start_ms, unnest(toks) AS word, unnest(range(len(toks))) AS pos
                   FROM v_recogniser WHERE NOT no_words AND {sb.strip('text')} <> '')) w WHERE word <> ''""",
)
def scan_words(spark, sf):
    words, _ = sentences.flatten_recogniser(recogniser(spark, sf), views.many_lines(spark, sf))
    return words.select("video_id", F.col("island").cast("long").alias("island"), "word_idx", "word", "start", "end")


@query(
    "segments_to_entries",
    f"""SELECT video_id, seg_idx, {sb.strip('text')} AS text, start, greatest(0.0, coalesce("end", start) - start) AS duration
        FROM v_recogniser WHERE {sb.strip('text')} <> ''""",
)
def segments_to_entries(spark, sf):
    return sentences.segments_to_entries(recogniser(spark, sf))


# ---- captions ----------------------------------------------------------------------------------
@query("scan_caption_events", "SELECT video_id, event_idx, text, start, duration FROM v_cues")
def scan_caption_events(spark, sf):
    return captions.cues(views.caption_events(spark, sf))


SQL_VIEWS["v_pseudo"] = """
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY event_idx, pos) - 1 AS word_idx, word,
    round(start + d * least(1.0, (cum - length(word) - 1) / tot::DOUBLE), 3) AS start,
    round(start + d * least(1.0, cum / tot::DOUBLE), 3) AS "end"
  FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY video_id, event_idx ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS cum,
               greatest(1, sum(length(word) + 1) OVER (PARTITION BY video_id, event_idx) - 1)::BIGINT AS tot
        FROM (SELECT video_id, event_idx, start, greatest(duration, 0.05::DOUBLE) AS d, unnest(w) AS word, unnest(range(len(w))) AS pos
              FROM (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM v_cues)))
"""


@query("pseudo_words", 'SELECT video_id, word_idx, word, start, "end" FROM v_pseudo')
def pseudo_words(spark, sf):
    many = views.many_lines(spark, sf, captions.CUE_BLOCK)
    return captions.pseudo_words(captions.cues(views.caption_events(spark, sf)), many).select(
        "video_id", "word_idx", "word", "start", "end"
    )


@query("caption_reflow")
def caption_reflow(spark, sf):
    return captions.caption_reflow(views.caption_events(spark, sf), many_cues=views.many_lines(spark, sf, captions.CUE_BLOCK))


# ---- chapters ----------------------------------------------------------------------------------
_FINALIZE = """
  SELECT video_id, idx AS "index", round(start, 3) AS start, round(e, 3) AS "end", title FROM (
    SELECT *, count(*) OVER (PARTITION BY video_id) AS n, bool_and(coalesce(e > start, false)) OVER (PARTITION BY video_id) AS fine FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS idx,
             coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY pos), CASE WHEN duration > start THEN duration ELSE "end" END) AS e FROM (
        SELECT *, max(start) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
        FROM {source} WHERE title <> '' AND start >= 0 AND (duration IS NULL OR start < duration))
      WHERE mx IS NULL OR start > mx))
  WHERE n >= 2 AND fine
"""
SQL_VIEWS["v_clean_chapters"] = f"SELECT video_id, pos, start, \"end\", duration, {sb.squeeze('title')} AS title FROM v_raw_chapters"
SQL_VIEWS["v_chapters"] = _FINALIZE.format(source="v_clean_chapters")
_STAMP = r"^\s*((?:\d{1,2}:)?\d{1,2}:\d{2})(?:\s*[-–—|]\s*|\s{2,}|\s+)(.+?)\s*$"
SQL_VIEWS["v_stamped"] = f"""
  SELECT *, first_value(start) OVER (PARTITION BY video_id ORDER BY pos) AS first_start FROM (
    SELECT video_id, duration, pos, NULL::DOUBLE AS "end", {sb.squeeze(f"regexp_extract(line, '{_STAMP}', 2)")} AS title,
      CASE WHEN p[-1]::BIGINT < 60 AND p[-2]::BIGINT < 60 THEN (CASE WHEN len(p) = 3 THEN p[1]::BIGINT * 3600 ELSE 0 END + p[-2]::BIGINT * 60 + p[-1]::BIGINT)::DOUBLE END AS start
    FROM (SELECT *, string_split(regexp_extract(line, '{_STAMP}', 1), ':') AS p FROM (
      SELECT video_id, duration, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (
        SELECT *, string_split(description, chr(10)) AS l FROM v_descriptions))
      WHERE regexp_matches(line, '{_STAMP}')))
  WHERE start IS NOT NULL AND title <> ''
"""
SQL_VIEWS["v_from_zero"] = "SELECT * FROM v_stamped WHERE first_start = 0"
SQL_VIEWS["v_desc_chapters"] = _FINALIZE.format(source="v_from_zero")


@query("normalize_chapters", "SELECT * FROM v_chapters")
def normalize_chapters(spark, sf):
    return chapters.normalize_chapters(views.raw_chapters(spark, sf))


@query("description_chapters", "SELECT * FROM v_desc_chapters")
def description_chapters(spark, sf):
    return chapters.description_chapters(views.descriptions(spark, sf))


@query(
    "chapters",
    """SELECT *, 'yt-dlp' AS source FROM v_chapters UNION ALL
       SELECT replace(video_id, 'd', 'v') AS video_id, "index", start, "end", title, 'description' AS source FROM v_desc_chapters
       WHERE replace(video_id, 'd', 'v') NOT IN (SELECT video_id FROM v_chapters)""",
)
def both_chapters(spark, sf):
    described = views.descriptions(spark, sf).withColumn("video_id", F.replace("video_id", F.lit("d"), F.lit("v")))
    return chapters.chapters(views.raw_chapters(spark, sf), described)


# ---- whole transcripts ---------------------------------------------------------------------------
@query(
    "full_text",
    """SELECT video_id, seg_idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", text AS piece
       FROM v_segments WHERE text IS NOT NULL""",
)
def full_text(spark, sf):
    return transcripts.full_text(views.segments(spark, sf))


SQL_VIEWS["v_labelled"] = f"""
  SELECT video_id, event_idx, '[' || {sb.fmt_time('start')} || '-' || {sb.fmt_time('start + duration')} || '] ' || text AS line FROM v_cues
"""


@query(
    "capped_transcript",
    f"""SELECT video_id, concat_ws(chr(10), string_agg(line, chr(10) ORDER BY event_idx) FILTER (fits),
             CASE WHEN bool_or(NOT fits) THEN '{fv.TRANSCRIPT_CAP_LINE}' END) AS transcript, bool_or(NOT fits) AS truncated
        FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY video_id ORDER BY event_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) <= 28000 AS fits FROM v_labelled) GROUP BY video_id""",
)
def capped_transcript(spark, sf):
    cues = captions.cues(views.caption_events(spark, sf)).withColumn("end", F.col("start") + F.col("duration"))
    return transcripts.capped_transcript(cues, order="event_idx")


@query(
    "transcript_stats",
    """SELECT video_id, count(*) AS n_segments, sum(len(regexp_split_to_array(text, '\\s+')))::BIGINT AS n_words,
         round(max(start + duration) - min(start), 3) AS covered_sec FROM v_cues GROUP BY video_id""",
)
def transcript_stats(spark, sf):
    cues = captions.cues(views.caption_events(spark, sf)).withColumn("end", F.col("start") + F.col("duration"))
    return transcripts.transcript_stats(cues, order="event_idx")


@query(
    "window_word_loss",
    """SELECT video_id, w AS "window", coalesce(a, 0) AS n_words, coalesce(b, 0) AS n_other,
         round(greatest(coalesce(a, 0) - coalesce(b, 0), 0) / greatest(coalesce(a, 0), 1)::DOUBLE, 6) AS loss FROM (
       SELECT video_id, floor(start / 50)::BIGINT AS w, count(*) AS a, count(*) FILTER (length(word) > 3) AS b FROM v_words GROUP BY ALL)""",
)
def window_word_loss(spark, sf):
    words = views.words(spark, sf)
    return transcripts.window_word_loss(words, words.where(F.length("word") > 3))


@query(
    "source_range",
    """SELECT video_id, seg_idx, start AS src_start, CASE WHEN e <= start THEN start + greatest(duration, 0.5) ELSE e END AS src_end FROM (
       SELECT *, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY seg_idx), start + duration) AS e FROM v_segments)""",
)
def source_range(spark, sf):
    return timing.source_range(views.segments(spark, sf)).select("video_id", "seg_idx", "src_start", "src_end")
