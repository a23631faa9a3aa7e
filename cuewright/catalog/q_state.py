"""Sources, sinks, catalogue, run log, indexes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.catalog import views
from cuewright.catalog.q_timing import chunks as all_chunks
from cuewright.catalog.q_timing import line_segments
from cuewright.catalog.registry import SQL_VIEWS, query
from cuewright.functions import numbers as num
from cuewright.operators import catalogue, chapters, indexing, runlog, transcripts
from cuewright.session import scratch_path, shuffles_freed, written_once
from cuewright.sources import readers, sinks
from cuewright.streaming import streams

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds_of(column: str):
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, cast({column} as timestamp_ntz))")


# ---- transcripts on disk ---------------------------------------------------------------------
SQL_VIEWS["v_stored"] = """
  SELECT video_id, conv_id, seg_idx, text, start, duration FROM v_segments WHERE conv_id % 10 <> 9 AND (conv_id + seg_idx) % 6 <> 5
"""


@query("scan_segments", "SELECT video_id, seg_idx, text, start, duration FROM v_stored")
def scan_segments(spark, sf):
    """Arrays with foreign elements (skipped, index kept) and whole broken payloads."""
    path = scratch_path(spark, "store")
    bad = F.pmod(F.col("conv_id") + F.col("seg_idx"), F.lit(6)) == 5
    item = F.when(bad, F.lit('"note"')).otherwise(F.to_json(F.struct("text", "start", "duration")))
    items = F.sort_array(F.collect_list(F.struct("seg_idx", item.alias("j"))))
    arrays = views.segments(spark, sf).groupBy("video_id", "conv_id").agg(
        F.array_join(F.transform(items, lambda x: x["j"]), ",").alias("body")
    )
    payload = F.when(F.col("conv_id") % 10 == 9, '{"broken":1}').otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    line = F.concat(F.lit('{"video_id":"'), F.col("video_id"), F.lit('","first_idx":0,"segments":'), payload, F.lit("}"))
    arrays.select(line.alias("value")).write.text(path)
    segments, _ = readers.read_segment_store(spark, path)
    return segments.select("video_id", "seg_idx", "text", "start", "duration")


@query(
    "sink_transcripts",
    "SELECT video_id, seg_idx, text, start, duration FROM v_segments",
)
def sink_transcripts(spark, sf):
    path = scratch_path(spark, "transcripts")
    sinks.write_transcripts(views.segments(spark, sf), path)
    segments, _ = readers.read_segment_store(spark, path)
    return segments.select("video_id", "seg_idx", "text", "start", "duration")


@query(
    "sink_segments",
    "SELECT video_id, seg_idx, CASE WHEN conv_id % 4 = 1 THEN 'mới: ' || text ELSE text END AS text FROM v_segments",
)
def sink_segments(spark, sf):
    """Write all videos, then replace a quarter of them."""
    path = scratch_path(spark, "segments")
    rows = views.segments(spark, sf).select("video_id", "seg_idx", "text", "conv_id")
    sinks.write_segments(rows, path)
    sinks.write_segments(rows.where(F.col("conv_id") % 4 == 1).withColumn("text", F.concat(F.lit("mới: "), F.col("text"))), path)
    return spark.read.parquet(path).select("video_id", "seg_idx", "text")


@query("sink_chunks")
def sink_chunks(spark, sf):
    """Stale chunks of a third of the videos, and of videos that have become empty, are replaced."""
    path, chunks = scratch_path(spark, "chunks"), written_once(all_chunks(spark, sf), "chunks")
    third = F.pmod(F.xxhash64("video_id"), F.lit(3)) == 0
    old = chunks.where(third).withColumn("text", F.lit("stale")).unionByName(chunks.where(third).withColumn("video_id", F.concat(F.lit("gone "), "video_id")))
    sinks.write_chunks(chunks.where(~third).unionByName(old), path)
    sinks.write_chunks(chunks.where(third), path, replaced=old.select("video_id").distinct())
    return sinks.read_chunks(spark, path)


@query(
    "scan_metadata",
    "SELECT video_id, title, channel, duration, view_count FROM v_meta",
)
def scan_metadata(spark, sf):
    path = scratch_path(spark, "metadata")
    views.metadata(spark, sf).select("video_id", "title", "channel", "duration", "view_count").write.json(path)
    return readers.read_metadata(spark, path).select("video_id", "title", "channel", "duration", "view_count")


@query(
    "build_metadata",
    """SELECT video_id, title, channel, 'https://x/' || channel AS channel_url, duration, view_count, NULL::VARCHAR AS upload_date FROM v_meta""",
)
def build_metadata(spark, sf):
    info = views.metadata(spark, sf).select(
        F.col("video_id").alias("id"),
        "title",
        F.col("channel").alias("uploader"),
        F.concat(F.lit("https://x/"), F.col("channel")).alias("uploader_url"),
        "duration",
        "view_count",
    )
    return catalogue.build_metadata(info).select(
        "video_id", "title", "channel", "channel_url", "duration", "view_count", "upload_date"
    )


# ---- summaries ---------------------------------------------------------------------------------
SQL_VIEWS["v_summaries"] = """
  SELECT video_id, summary, segments, created_at FROM (
    SELECT 'd' || (doc_id // 3) AS video_id, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS summary, n_chars AS segments, doc_id::DOUBLE AS created_at,
      row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1
"""


def _summaries(spark, sf):
    doc = F.col("doc_id")
    return views.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.floor(doc / 3).cast("long")).alias("video_id"),
        F.when(doc % 7 == 3, "").otherwise(F.col("text")).alias("summary"),
        F.col("n_chars").alias("segments"),
        doc.cast("double").alias("created_at"),
    )


@query("sink_summaries", "SELECT video_id, summary, created_at FROM v_summaries")
def sink_summaries(spark, sf):
    """Two rounds of upserts; the newest row per video stays."""
    path = scratch_path(spark, "summaries")
    rows = _summaries(spark, sf)
    sinks.write_summaries(rows.withColumns({"created_at": F.lit(-1.0), "summary": F.lit("old")}), path)
    sinks.write_summaries(rows, path)
    return spark.read.parquet(path).select("video_id", "summary", "created_at")


@query("scan_summaries", "SELECT video_id, summary, segments, true AS cached FROM v_summaries WHERE summary <> ''")
def scan_summaries(spark, sf):
    path = scratch_path(spark, "summaries")
    newest = _summaries(spark, sf).groupBy("video_id").agg(
        F.max_by(F.struct("summary", "segments", "created_at"), "created_at").alias("r")
    )
    newest.select("video_id", "r.*").write.json(path)
    return readers.read_summaries(spark, path).select("video_id", "summary", "segments", "cached")


# ---- glossary ----------------------------------------------------------------------------------
@query(
    "scan_glossary",
    """SELECT written, arg_min(spoken, prio || spoken) AS spoken FROM (
         SELECT trim(written) AS written, trim(spoken) AS spoken, '0' AS prio FROM (
           SELECT CASE p_partkey % 5 WHEN 0 THEN 'RAM' WHEN 1 THEN ' ' ELSE p_name END AS written, ' ' || p_brand || ' ' AS spoken FROM part) WHERE trim(written) <> ''
         UNION ALL SELECT * FROM (VALUES ('RAM', 'ram', '1'), ('ROM', 'rôm', '1'), ('VRAM', 'vi ram', '1'), ('LAN', 'lan', '1'), ('SIM', 'sim', '1'),
           ('PIN', 'pin', '1'), ('NASA', 'na sa', '1'), ('NVIDIA', 'en vi đi ei', '1')))
       GROUP BY written""",
)
def scan_glossary(spark, sf):
    """User files written as JSON objects and read back, over the built-in entries."""
    path = scratch_path(spark, "glossary")
    key = F.when(F.col("p_partkey") % 5 == 0, "RAM").when(F.col("p_partkey") % 5 == 1, " ").otherwise(F.col("p_name"))
    entries = views.table(spark, sf, "part").select(
        F.to_json(F.create_map(key, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))).alias("value")
    )
    entries.write.text(path)
    # One small object per line here; whole files are read by ``read_glossary``.
    user = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("written", "spoken"))
    return catalogue.overlay_glossary(fv.BUILTIN_GLOSSARY, user)


# ---- listings ----------------------------------------------------------------------------------
@query("scan_artifacts", "SELECT video_id, 'txt' AS kind, sum(strlen(text) + 1)::BIGINT AS length FROM v_segments WHERE text IS NOT NULL GROUP BY video_id")
def scan_artifacts(spark, sf):
    """One transcript file per video: its folder, its kind and its length."""
    path = scratch_path(spark, "artifacts")
    sinks.write_files(transcripts.full_text(views.segments(spark, sf)), path, "seg_idx", " ")
    found = readers.list_artifacts(spark, path, "*.txt").where("mtime is not null")
    return found.select(F.replace("folder", F.lit("video_id="), F.lit("")).alias("video_id"), F.regexp_extract("name", r"([^.]*)$", 1).alias("kind"), "length")


SQL_VIEWS["v_outputs"] = "SELECT 'c' || o_custkey AS video_id, epoch(o_orderdate)::BIGINT AS mtime FROM orders WHERE o_orderstatus = 'F'"
SQL_VIEWS["v_loaded"] = "SELECT 'c' || o_custkey AS video_id, epoch(o_orderdate)::BIGINT AS mtime FROM orders WHERE o_orderstatus = 'O'"
SQL_VIEWS["v_cards"] = """
  SELECT 'c' || c_custkey AS video_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS title,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS channel, c_nationkey AS view_count, c_acctbal AS duration, 1000000000 + c_custkey AS mtime FROM customer
"""


def _orders(spark, sf, status):
    return views.table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("video_id"), seconds_of("o_orderdate").alias("mtime")
    )


def _cards(spark, sf):
    return views.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("video_id"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("title"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("channel"),
        F.col("c_nationkey").alias("view_count"),
        F.col("c_acctbal").alias("duration"),
        (F.col("c_custkey") + 1000000000).alias("mtime"),
    )


@query("distinct_keys", "SELECT video_id, max(mtime) AS mtime FROM v_outputs GROUP BY video_id")
def distinct_keys(spark, sf):
    return catalogue.distinct_keys(_orders(spark, sf, "F"))


_CARD = "coalesce(nullif(title, ''), video_id) AS title, coalesce(channel, '—') AS channel, view_count, duration"


@query(
    "list_library",
    f"SELECT video_id, {_CARD}, updated_at FROM (SELECT video_id, max(mtime) AS updated_at FROM v_outputs GROUP BY video_id) LEFT JOIN v_cards USING (video_id)",
)
def list_library(spark, sf):
    return catalogue.list_library(_orders(spark, sf, "F"), _cards(spark, sf).drop("mtime"))


@query(
    "list_drafts",
    f"""SELECT video_id, {_CARD}, greatest(mtime, t) AS updated_at FROM v_cards JOIN (SELECT video_id, max(mtime) AS t FROM v_loaded GROUP BY video_id) USING (video_id)
        WHERE video_id NOT IN (SELECT video_id FROM v_outputs)""",
)
def list_drafts(spark, sf):
    return catalogue.list_drafts(_cards(spark, sf), _orders(spark, sf, "O"), _orders(spark, sf, "F"))


@query("pending_work", "SELECT video_id FROM v_cards WHERE video_id NOT IN (SELECT video_id FROM v_outputs)")
def pending_work(spark, sf):
    return catalogue.pending_work(_cards(spark, sf).select("video_id"), _orders(spark, sf, "F"))


SQL_VIEWS["v_candidates"] = """
  SELECT 'c' || o_custkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'cache' WHEN 'O' THEN 'manual_sub' ELSE 'whisper' END AS source,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority, o_orderkey % 3 AS lang_rank, 'l' || (o_orderkey % 3) AS lang, count(*) AS n_rows
  FROM orders GROUP BY ALL
"""


@query(
    "pick_transcript_source",
    """SELECT video_id, source, lang, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY priority, lang_rank, source) AS r FROM v_candidates) WHERE r = 1""",
)
def pick_transcript_source(spark, sf):
    status, lang = F.col("o_orderstatus"), F.col("o_orderkey") % 3
    candidates = views.table(spark, sf, "orders").groupBy(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("video_id"),
        F.when(status == "F", "cache").when(status == "O", "manual_sub").otherwise("whisper").alias("source"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("priority"),
        lang.alias("lang_rank"),
        F.concat(F.lit("l"), lang).alias("lang"),
    ).agg(F.count("*").alias("n_rows"))
    return catalogue.pick_transcript_source(candidates)


@query(
    "delete_videos",
    """SELECT i.video_id, coalesce(sum(n), 0)::BIGINT AS deleted, count(n) AS artifacts,
         CASE WHEN NOT regexp_matches(i.video_id, '^[A-Za-z0-9_-]+$') THEN 'bad_id' WHEN sum(n) IS NULL THEN 'not_found' END AS error
       FROM (SELECT DISTINCT CASE user_id % 9 WHEN 4 THEN 'v ' || user_id ELSE 'v' || user_id END AS video_id FROM events) i
       LEFT JOIN (SELECT video_id, count(*) AS n FROM v_segments GROUP BY video_id UNION ALL SELECT video_id, count(*) FROM v_meta GROUP BY video_id
                  UNION ALL SELECT video_id, count(*) FROM v_chapters GROUP BY video_id) t USING (video_id) GROUP BY i.video_id""",
)
def delete_videos(spark, sf):
    user = F.col("user_id")
    ids = views.table(spark, sf, "events").select(
        F.when(user % 9 == 4, F.concat(F.lit("v "), user)).otherwise(F.concat(F.lit("v"), user)).alias("video_id")
    )
    artifacts = {
        "segments": views.segments(spark, sf).select("video_id"),
        "metadata": views.metadata(spark, sf).select("video_id"),
        "chapters": chapters.normalize_chapters(views.raw_chapters(spark, sf)).select("video_id"),
    }
    return catalogue.delete_report(ids, artifacts)


@query(
    "delete_stored_videos",
    """SELECT t, video_id, count(*) AS rows FROM (
         SELECT 'segments' AS t, video_id, conv_id FROM v_segments UNION ALL SELECT 'metadata', video_id, conv_id FROM v_meta)
       WHERE conv_id % 3 <> 0 GROUP BY t, video_id""",
)
def delete_stored_videos(spark, sf):
    """Every third video goes from two stored tables; what is left in both."""
    tables = {"segments": views.segments(spark, sf), "metadata": views.metadata(spark, sf)}
    paths = {name: scratch_path(spark, name) for name in tables}
    for name, rows in tables.items():
        sinks.upsert_by_video(rows.drop("bucket"), paths[name])
    sinks.delete_videos(tables["metadata"].where(F.col("conv_id") % 3 == 0), list(paths.values()))
    left = [spark.read.parquet(p).select(F.lit(name).alias("t"), "video_id") for name, p in paths.items()]
    return left[0].unionByName(left[1]).groupBy("t", "video_id").agg(F.count("*").alias("rows"))


# ---- indexes and chapters ------------------------------------------------------------------------
@query(
    "stale_index",
    """SELECT video_id, CASE WHEN m = 0 THEN 'missing' ELSE 'stale' END AS reason FROM (SELECT video_id, conv_id % 6 AS m FROM v_meta) WHERE m <> 5""",
)
def stale_index(spark, sf):
    m = F.col("conv_id") % 6
    meta = views.metadata(spark, sf)
    indexed = meta.where(m != 0).select(
        "video_id",
        F.when(m == 1, "old").otherwise(fv.RAG_VERSION).alias("rag_version"),
        F.when(m != 2, 0.0).alias("start"),
        F.lit(1.0).alias("end"),
        F.when(m == 3, "other").otherwise("hashing").alias("embedding_provider"),
        F.when(m != 4, "tf-256").alias("embedding_model"),
    )
    return catalogue.stale_index(meta.select("video_id"), indexed, "hashing", "tf-256")


@query(
    "backfill_chapters",
    """SELECT m.video_id, CASE WHEN m.conv_id % 3 = 0 THEN 0 ELSE n END AS n_chapters, CASE WHEN m.conv_id % 3 = 0 THEN 'old' ELSE CASE WHEN n IS NOT NULL THEN 'yt-dlp' END END AS chapters_source
       FROM v_meta m LEFT JOIN (SELECT video_id, count(*) AS n FROM v_chapters GROUP BY video_id) c USING (video_id)""",
)
def backfill_chapters(spark, sf):
    found = chapters.normalize_chapters(views.raw_chapters(spark, sf))
    fresh = found.groupBy("video_id").agg(
        F.sort_array(F.collect_list("start")).alias("chapters"), F.lit("yt-dlp").alias("chapters_source")
    )
    old = F.col("conv_id") % 3 == 0
    stored = views.metadata(spark, sf).select(
        "video_id",
        F.when(old, F.array().cast("array<double>")).alias("chapters"),
        F.when(old, "old").alias("chapters_source"),
    )
    done = catalogue.backfill_chapters(stored, fresh)
    return done.select(
        "video_id", F.when(F.col("chapters").isNotNull(), F.size("chapters")).cast("long").alias("n_chapters"), "chapters_source"
    )


@query("incremental_index")
def incremental_index(spark, sf):
    """First run over two thirds of the videos, second run over all: only the rest is indexed. The chunks of both, with the second run's reason."""
    path = scratch_path(spark, "index")
    lines = line_segments(spark, sf).select(
        "video_id", "seg_idx", "start", (F.col("start") + F.col("duration")).alias("end"), "text"
    )
    lines = written_once(lines, "lines")  # read by both runs, for hashes and for chunks
    part = F.substring("video_id", 2, 20).cast("long") % 3 > 0
    indexing.incremental_index(lines.where(part), path)
    todo = indexing.incremental_index(lines, path)
    chunks = sinks.read_chunks(spark, path).join(todo, "video_id", "left")
    return chunks.select("video_id", "chunk_pos", "start", "end", "text", F.size("vec").alias("dims"), "reason")


# ---- run log -----------------------------------------------------------------------------------
SQL_VIEWS["v_run_events"] = """
  SELECT video_id AS run_id, ts_us, event_id, event_type AS status, CASE WHEN event_id % 3 = 0 THEN value END AS total_time_sec,
    CASE WHEN event_id % 5 = 1 THEN 'faster:' || (event_id % 7) END AS asr_engine FROM v_events
"""
SQL_VIEWS["v_run_state"] = """
  SELECT run_id, arg_max(status, ts_us * 1000000::HUGEINT + event_id) AS status,
    arg_max(total_time_sec, ts_us * 1000000::HUGEINT + event_id) FILTER (total_time_sec IS NOT NULL) AS total_time_sec,
    arg_max(asr_engine, ts_us * 1000000::HUGEINT + event_id) FILTER (asr_engine IS NOT NULL) AS asr_engine, count(*) AS n_events
  FROM v_run_events GROUP BY run_id
"""
FIELDS = ["status", "total_time_sec", "asr_engine"]


def _run_events(spark, sf):
    e = F.col("event_id")
    return views.events(spark, sf).select(
        F.col("video_id").alias("run_id"),
        "ts_us",
        "event_id",
        F.col("event_type").alias("status"),
        F.when(e % 3 == 0, F.col("value")).alias("total_time_sec"),
        F.when(e % 5 == 1, F.concat(F.lit("faster:"), e % 7)).alias("asr_engine"),
    )


def _run_state(spark, sf):
    return runlog.run_log_state(_run_events(spark, sf), "run_id", ["ts_us", "event_id"], FIELDS)


@query("run_log_state", "SELECT * FROM v_run_state")
def run_log_state(spark, sf):
    return _run_state(spark, sf)


_CELL = "CASE WHEN {0} IS NULL THEN 'NaN' ELSE printf('%.3f', {0}) END"
SQL_VIEWS["v_run_text"] = f"""
  SELECT run_id, {_CELL.format('total_time_sec')} AS total_time_sec, coalesce(asr_engine, 'NaN') AS asr_engine, status, 'NaN' AS mode, n_events::VARCHAR AS run_index FROM v_run_state
"""


@query("format_run_log", "SELECT * FROM v_run_text")
def format_run_log(spark, sf):
    rows = _run_state(spark, sf).withColumnRenamed("n_events", "run_index")
    return sinks.run_log_text(rows).select("run_id", "total_time_sec", "asr_engine", "status", "mode", "run_index")


@query(
    "scan_run_log",
    """SELECT run_id, nullif(total_time_sec, 'NaN') AS total_time_sec, nullif(total_time_sec, 'NaN') AS asr_time_sec, nullif(asr_engine, 'NaN') AS asr_engine, status, NULL::VARCHAR AS created_at FROM v_run_text""",
)
def scan_run_log(spark, sf):
    """An old log: no ``created_at``, and the recogniser time under its former name."""
    path = scratch_path(spark, "runlog")
    text = sinks.run_log_text(_run_state(spark, sf))
    old = text.drop("created_at", "asr_time_sec").withColumn("whisper_time_sec", F.col("total_time_sec"))
    old.write.csv(path, header=True)
    return readers.read_run_log(spark, path).select(
        "run_id", "total_time_sec", "asr_time_sec", "asr_engine", "status", "created_at"
    )


@query(
    "next_run_index",
    """SELECT event_id, video_id, coalesce(m, 0) + row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS run_index,
         video_id || '_' || (coalesce(m, 0) + row_number() OVER (PARTITION BY video_id ORDER BY event_id)) AS run_id
       FROM (SELECT * FROM v_events WHERE event_type = 'signup')
       LEFT JOIN (SELECT video_id, max(json_extract(props, '$.k')::BIGINT) AS m FROM v_events WHERE event_type = 'view' AND event_id % 4 <> 3 GROUP BY video_id) USING (video_id)""",
)
def next_run_index(spark, sf):
    events = views.events(spark, sf)
    kind = F.col("event_type")
    stored = F.when(F.col("event_id") % 4 != 3, F.get_json_object("props", "$.k")).otherwise("?")
    existing = events.where(kind == "view").select("video_id", stored.alias("run_index"))
    requests = events.where(kind == "signup").select("video_id", "event_id")
    return runlog.next_run_index(existing, requests, "event_id", F.floor(F.col("event_id") / 65536).cast("long"))


SQL_VIEWS["v_dubbing"] = """
  SELECT m.video_id, s.run_id, CASE WHEN m.conv_id % 2 = 0 THEN 'omnivoice' ELSE 'supertonic' END AS engine, m.conv_id, s.asr_engine, s.total_time_sec
  FROM v_meta m LEFT JOIN v_run_state s ON s.run_id = 'u' || m.conv_id
"""


def _dubbing(spark, sf):
    runs = _run_state(spark, sf).select(
        "run_id",
        F.lit(None).cast("string").alias("video_id"),
        "asr_engine",
        F.lit(fv.NAN).alias("asr_time_sec"),
        F.lit("").alias("tts_batch_size"),
        F.lit("gpu").alias("mode"),
        F.lit(fv.NAN).alias("tts_time_sec"),
        F.format_string("%.3f", "total_time_sec").alias("total_time_sec"),
    )
    conv = F.col("conv_id")
    meta = views.metadata(spark, sf).select(
        "video_id",
        F.concat(F.lit("u"), conv).alias("latest_run_id"),
        F.when(conv % 2 == 0, "omnivoice").otherwise("supertonic").alias("engine"),
        (conv % 3).alias("batch_size"),
        F.when(conv % 4 == 0, "api").when(conv % 4 == 1, "manual").otherwise("odd").alias("translation_mode"),
    )
    return catalogue.dubbing_metadata(runs, meta)


@query(
    "dubbing_metadata",
    """SELECT video_id, 'u' || conv_id AS run_id, CASE engine WHEN 'omnivoice' THEN 'OmniVoice - GPU' ELSE 'Supertonic - CPU' END AS engine_label,
         CASE WHEN engine = 'omnivoice' AND conv_id % 3 > 0 THEN (conv_id % 3)::VARCHAR END AS batch_size, CASE WHEN asr_engine IS NOT NULL THEN 'whisper' END AS asr_source, asr_engine,
         CASE conv_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'manual' END AS translation_mode, CASE WHEN run_id IS NOT NULL THEN 'gpu' END AS mode, printf('%.3f', total_time_sec) AS total_time_sec FROM v_dubbing""",
)
def dubbing_metadata(spark, sf):
    d = "dubbing"
    return _dubbing(spark, sf).select(
        "video_id",
        F.col(f"{d}.run_id").alias("run_id"),
        F.col(f"{d}.tts.engine_label").alias("engine_label"),
        F.col(f"{d}.tts.batch_size").alias("batch_size"),
        F.col(f"{d}.asr.source").alias("asr_source"),
        F.col(f"{d}.asr.engine").alias("asr_engine"),
        F.col(f"{d}.translation.mode").alias("translation_mode"),
        F.col(f"{d}.run.mode").alias("mode"),
        F.when(F.col(f"{d}.run.total_time_sec") != "null", F.col(f"{d}.run.total_time_sec")).alias("total_time_sec"),
    )


@query(
    "run_details",
    """SELECT video_id, label, value FROM (
         SELECT video_id, unnest(['TTS engine', 'Batch TTS', 'ASR', 'Dịch', 'Thời gian xử lý', 'Run ID']) AS label,
           unnest([CASE engine WHEN 'omnivoice' THEN 'OmniVoice - GPU' ELSE 'Supertonic - CPU' END, CASE WHEN engine = 'omnivoice' AND conv_id % 3 > 0 THEN (conv_id % 3)::VARCHAR END, asr_engine,
             CASE conv_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'manual' END, 'Tổng ' || printf('%.1f', round(total_time_sec, 1)) || 's', 'u' || conv_id]) AS value FROM v_dubbing)
       WHERE trim(coalesce(value, '')) <> ''""",
)
def run_details(spark, sf):
    return catalogue.run_details(_dubbing(spark, sf))


# ---- sweeps and sessions -------------------------------------------------------------------------
@query(
    "sweep_compare",
    """SELECT model, mb AS max_batch, round((be / greatest(te, 0.01) - 1) * 100, 4) AS speed_gain, round(abs(ts - bs) / greatest(bs, 1.0) * 100, 4) AS segment_diff,
         round(abs(tw - bw) / greatest(bw, 1.0) * 100, 4) AS word_diff, round(abs(tc - bc) / greatest(bc, 0.01) * 100, 4) AS coverage_diff FROM (
       SELECT model, max(batch) AS mb, arg_min(elapsed, batch) AS be, arg_max(elapsed, batch) AS te, arg_min(n_segments, batch) AS bs, arg_max(n_segments, batch) AS ts,
         arg_min(n_words, batch) AS bw, arg_max(n_words, batch) AS tw, arg_min(covered, batch) AS bc, arg_max(covered, batch) AS tc FROM (
         SELECT 's' || l_suppkey AS model, l_linenumber AS batch, round(sum(l_extendedprice) / 100, 2)::DOUBLE AS elapsed, count(*) AS n_segments,
           sum(l_quantity)::BIGINT AS n_words, max(l_extendedprice)::DOUBLE AS covered FROM lineitem GROUP BY ALL) GROUP BY model HAVING min(batch) = 1 AND max(batch) > 1)""",
)
def sweep_compare(spark, sf):
    runs = views.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("model"), F.col("l_linenumber").alias("batch")
    ).agg(
        F.round(F.sum("l_extendedprice") / 100, 2).alias("elapsed"),
        F.count("*").alias("n_segments"),
        F.sum("l_quantity").cast("long").alias("n_words"),
        F.max("l_extendedprice").alias("covered"),
    )
    return catalogue.sweep_compare(runs)


@query(
    "pause_sessions",
    """SELECT video_id, session, count(*) AS n_events, min(ts_us) AS start_us, max(ts_us) AS end_us FROM (
         SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
           SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY video_id ORDER BY ts_us, event_id) < 21600000000 THEN 0 ELSE 1 END AS o FROM v_events))
       GROUP BY video_id, session""",
)
def pause_sessions(spark, sf):
    return runlog.pause_sessions(views.events(spark, sf), 6 * 3600)


@query("progress_throttle")
def progress_throttle(spark, sf):
    cues = views.lines(spark, sf).withColumn("end", (F.col("start_ms") + F.col("dur_ms")) / 1000.0)
    total = cues.groupBy("video_id").agg(F.max("end").alias("total"))
    rows = cues.select("video_id", F.col("line_idx").alias("pos"), "end").join(total, "video_id")
    return runlog.progress_throttle(rows)


# ---- streams -----------------------------------------------------------------------------------
#: Files of words in one batch of a stream; a table has eight for each of its splits.
STREAM_FILES = 64


@query(
    "stream_sentences",
    """SELECT video_id, run_start, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text, min(start) AS start, max("end") AS "end"
       FROM v_runs GROUP BY video_id, run_start""",
)
def stream_sentences(spark, sf):
    """All words as a file stream, one barrier row per video at its end."""
    source, out, state = (scratch_path(spark, n) for n in ("words", "sentences", "state"))
    words = views.words(spark, sf)
    # A batch shuffles all it reads. Words lie in their video's file, so videos may come batch by batch, but not where a long one has several files.
    files = {} if views.many_words(spark, sf) else {"maxFilesPerTrigger": STREAM_FILES}
    with shuffles_freed(spark):
        words.write.parquet(source)
    ends = spark.read.schema(words.schema).parquet(source).groupBy("video_id").agg((F.max("word_idx") + 1).alias("word_idx")).select(
        "video_id",
        "word_idx",
        F.lit(None).cast("string").alias("word"),
        F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("end"),
    )
    with shuffles_freed(spark):
        ends.write.mode("append").parquet(source)
        stream = spark.readStream.schema(words.schema).options(**files).parquet(source)
        built = streams.stream_sentences(stream, max_words=0)
        run = built.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
    return spark.read.schema(built.schema).parquet(out)


@query("stream_index")
def stream_index(spark, sf):
    source, index, state = (scratch_path(spark, n) for n in ("segments", "index", "state"))
    lines = line_segments(spark, sf).select(
        "video_id", "seg_idx", "start", (F.col("start") + F.col("duration")).alias("end"), "text"
    )
    # Two deliveries, so that most videos arrive in parts; each of as many files as its tasks write, indexed before the next comes.
    for part in range(2):
        lines.where(F.pmod("seg_idx", F.lit(2)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(lines.schema).parquet(source)
        streams.stream_index(stream, index, state).awaitTermination()
    return sinks.read_chunks(spark, index).select("video_id", "chunk_pos", "segment_start", "segment_end", "start", "end", "text")


@query("stream_run_log", "SELECT run_id AS video_id, status, total_time_sec, asr_engine FROM v_run_state")
def stream_run_log(spark, sf):
    source, table, state = (scratch_path(spark, n) for n in ("events", "runs", "state"))
    events = _run_events(spark, sf).withColumnRenamed("run_id", "video_id")
    rows = events.withColumn("seq", F.struct("ts_us", "event_id")).drop("ts_us", "event_id")
    # Three deliveries, each with late events.
    for part in range(3):
        rows.where(F.pmod(F.col("seq.event_id"), F.lit(3)) == part).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_run_log(stream, table, state, FIELDS).awaitTermination()
    return spark.read.parquet(table).select("video_id", *FIELDS)


@query(
    "gain_of_stored",
    """SELECT video_id, round(pow(least(greatest(coalesce(p, 0.0), 0.0), 100.0) / 100.0::DOUBLE, 2), 6) AS gain FROM (
         SELECT video_id, CASE WHEN conv_id % 2 = 0 THEN (conv_id % 120)::DOUBLE END AS p FROM v_meta)""",
)
def gain_of_stored(spark, sf):
    stored = F.when(F.col("conv_id") % 2 == 0, (F.col("conv_id") % 120).cast("double"))
    return views.metadata(spark, sf).select("video_id", num.percent_to_gain(num.stored_voice_percent(stored)).alias("gain"))
