"""The operators' inputs, derived by Spark from the provided tables; each with its SQL twin.

All times are running sums of integer milliseconds, divided by 1000 last, so both engines agree
exactly. Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.catalog.registry import SQL_VIEWS
from cuewright.plans.blocked import BLOCK_ROWS, block_of, dense_position, many_blocks, running

DAY = 86_400
# Tables whose rows fan out into many words or lines.
WIDE_TEXT = ("documents",)
# Parts that one split of such a table is dealt into.
FAN_OUT = 8


# A generator that is not "outer" makes Spark test its argument in a filter as well, which would
# tokenise every text twice; hence the outer generators here and in the operators.
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table; one stored in fewer files than there are cores is spread before use."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in WIDE_TEXT and df.rdd.getNumPartitions() < cores else df


def texts_by_video(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' texts, dealt by video before they fan out into words or lines.

    Whatever is keyed by video after that finds its rows in place, so texts are shuffled and their words are not. The number
    of parts follows the size of the table, which the texts' own bytes would understate for their words.
    """
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = max(FAN_OUT * docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    return docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("video_id"), "text").repartition(parts, "video_id")


def _tokens(text):
    return F.split(F.btrim(text, F.lit(" \n\t\r")), r"\s+")


def many_words(spark: SparkSession, sf: str) -> bool:
    """True when some document's words go past a first block; counted on the texts, before they fan out."""
    return many_blocks(table(spark, sf, "documents"), F.size(_tokens(F.col("text"))) - 1)


def many_lines(spark: SparkSession, sf: str, size: int = BLOCK_ROWS) -> bool:
    """The same for lines and blocks of ``size`` of them."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return many_blocks(table(spark, sf, "documents"), breaks, size)


# ---- segments: conversations as transcripts ------------------------------------------------------
SQL_VIEWS["v_segments"] = """
  SELECT video_id, seg_idx, role, text,
         CASE seg_idx % 5 WHEN 4 THEN NULL WHEN 3 THEN '' ELSE 'vi: ' || text END AS text_vi,
         CASE WHEN seg_idx % 3 = 1 THEN NULL ELSE 'tts ' || text END AS text_tts,
         dur_ms, start_ms, start_ms / 1000.0::DOUBLE AS start, dur_ms / 1000.0::DOUBLE AS duration, conv_id
  FROM (SELECT *, coalesce(sum(dur_ms + CASE seg_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 400 ELSE 2100 END) OVER (
                 PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
        FROM (SELECT 'v' || conv_id AS video_id, conv_id, turn AS seg_idx, role, text,
                     least(9000, 400 + 55 * length(text))::BIGINT AS dur_ms FROM conversations))
"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(F.col("seg_idx") % 3 == 0, 0).when(F.col("seg_idx") % 3 == 1, 400).otherwise(2100)
    base = table(spark, sf, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id")).alias("video_id"),
        "conv_id",
        F.col("turn").alias("seg_idx"),
        "role",
        "text",
        F.least(F.lit(9000), 400 + 55 * F.length("text")).cast("long").alias("dur_ms"),
    )
    placed = running(
        base.withColumn("_blk", block_of("seg_idx")),
        ["video_id"],
        ["seg_idx"],
        {"start_ms": ("sum", F.col("dur_ms") + gap)},
        inclusive=False,
    ).drop("_blk")
    return placed.select(
        "video_id",
        "seg_idx",
        "role",
        "text",
        F.when(F.col("seg_idx") % 5 == 4, None)
        .when(F.col("seg_idx") % 5 == 3, "")
        .otherwise(F.concat(F.lit("vi: "), F.col("text")))
        .alias("text_vi"),
        F.when(F.col("seg_idx") % 3 == 1, None).otherwise(F.concat(F.lit("tts "), F.col("text"))).alias("text_tts"),
        "dur_ms",
        "start_ms",
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("dur_ms") / 1000.0).alias("duration"),
        "conv_id",
    )


# ---- timed segments: nested and legacy generated timing in all mixtures ---------------------------
SQL_VIEWS["v_timed"] = """
  SELECT *, CASE WHEN m IN (0, 1, 2) THEN (start_ms + 50) / 1000.0::DOUBLE END AS n_tts_start,
         CASE WHEN m IN (0, 1) THEN (start_ms + 50 + dur_ms - dur_ms % 7) / 1000.0::DOUBLE
              WHEN m = 2 AND seg_idx % 2 = 0 THEN (start_ms - 10) / 1000.0::DOUBLE END AS n_tts_end,
         CASE WHEN m = 0 THEN (start_ms + 20) / 1000.0::DOUBLE END AS n_pb_tts_start,
         CASE WHEN m IN (0, 3) THEN (start_ms + 20 + dur_ms) / 1000.0::DOUBLE END AS n_pb_tts_end,
         CASE WHEN m IN (0, 3) THEN (start_ms + 5) / 1000.0::DOUBLE END AS n_pb_start,
         CASE WHEN m IN (0, 3) THEN (start_ms + 5 + dur_ms) / 1000.0::DOUBLE END AS n_pb_end,
         CASE WHEN m = 4 THEN (start_ms + 70) / 1000.0::DOUBLE END AS l_tts_start,
         CASE WHEN m = 4 THEN (start_ms + 70 + (seg_idx % 2) * dur_ms) / 1000.0::DOUBLE END AS l_tts_end,
         CASE WHEN m = 5 THEN (start_ms + 80) / 1000.0::DOUBLE END AS l_pb_tts_start,
         CASE WHEN m = 5 THEN (start_ms + 80 + dur_ms) / 1000.0::DOUBLE END AS l_pb_tts_end,
         CASE WHEN m IN (1, 4) THEN (start_ms + 90) / 1000.0::DOUBLE END AS l_pb_start,
         CASE WHEN m IN (1, 4) THEN (start_ms + 90 + dur_ms) / 1000.0::DOUBLE END AS l_pb_end
  FROM (SELECT *, (conv_id * 3 + seg_idx) % 6 AS m FROM v_segments)
"""


def timed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with nested ``tts`` / ``playback`` structs and the flat legacy columns."""
    m = F.col("m")

    def at(condition, milliseconds):
        return F.when(condition, milliseconds / 1000.0)

    start, dur = F.col("start_ms"), F.col("dur_ms")
    df = segments(spark, sf).withColumn("m", (F.col("conv_id") * 3 + F.col("seg_idx")) % 6)
    tts = F.struct(
        at(m.isin(0, 1, 2), start + 50).alias("start"),
        F.coalesce(
            at(m.isin(0, 1), start + 50 + dur - dur % 7),
            at((m == 2) & (F.col("seg_idx") % 2 == 0), start - 10),
        ).alias("end"),
        F.when(m.isin(0, 1, 2), F.when(F.col("seg_idx") % 2 == 0, "omnivoice").otherwise("supertonic")).alias("engine"),
        F.when(m == 0, F.lit(32)).alias("num_step"),
        at(m.isin(0, 1, 2), dur - dur % 7).alias("duration"),
    )
    playback = F.struct(
        F.when(m == 0, F.lit(1.25)).alias("speed"),
        at(m.isin(0, 3), start + 5).alias("start"),
        at(m.isin(0, 3), start + 5 + dur).alias("end"),
        at(m == 0, start + 20).alias("tts_start"),
        at(m.isin(0, 3), start + 20 + dur).alias("tts_end"),
    )
    return df.withColumns(
        {
            "tts": F.when(m.isin(0, 1, 2), tts),
            "playback": F.when(m.isin(0, 3), playback),
            "tts_start": at(m == 4, start + 70),
            "tts_end": at(m == 4, start + 70 + (F.col("seg_idx") % 2) * dur),
            "tts_playback_start": at(m == 5, start + 80),
            "tts_playback_end": at(m == 5, start + 80 + dur),
            "playback_start": at(m.isin(1, 4), start + 90),
            "playback_end": at(m.isin(1, 4), start + 90 + dur),
        }
    )


# ---- metadata: one record per conversation -------------------------------------------------------
SQL_VIEWS["v_meta"] = """
  SELECT video_id, conv_id, n_segments, duration, title, channel, view_count FROM (
    SELECT video_id, conv_id, count(*) AS n_segments,
           CASE conv_id % 7 WHEN 6 THEN NULL ELSE max(start_ms + dur_ms) / (CASE conv_id % 5 WHEN 2 THEN 2000.0::DOUBLE ELSE 1000.0::DOUBLE END) END AS duration,
           CASE conv_id % 4 WHEN 3 THEN NULL ELSE arg_min(text, seg_idx) END AS title,
           CASE conv_id % 3 WHEN 0 THEN 'Kênh ' || (conv_id % 10) WHEN 1 THEN 'Channel ' || (conv_id % 10) ELSE '' END AS channel,
           sum(length(text))::BIGINT AS view_count
    FROM v_segments GROUP BY video_id, conv_id)
"""


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    conv = F.col("conv_id")
    grouped = segments(spark, sf).groupBy("video_id", "conv_id").agg(
        F.count("*").alias("n_segments"),
        F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        F.min_by("text", "seg_idx").alias("first_text"),
        F.sum(F.length("text")).alias("view_count"),
    )
    divisor = F.when(conv % 5 == 2, 2000.0).otherwise(1000.0)
    return grouped.select(
        "video_id",
        "conv_id",
        "n_segments",
        F.when(conv % 7 != 6, F.col("end_ms") / divisor).alias("duration"),
        F.when(conv % 4 != 3, F.col("first_text")).alias("title"),
        F.when(conv % 3 == 0, F.concat(F.lit("Kênh "), conv % 10))
        .when(conv % 3 == 1, F.concat(F.lit("Channel "), conv % 10))
        .otherwise("")
        .alias("channel"),
        "view_count",
    )


# ---- words ------------------------------------------------------------------------------------
SQL_VIEWS["v_words"] = """
  SELECT video_id, word_idx, word, start_ms / 1000.0::DOUBLE AS start, (start_ms + dur_ms) / 1000.0::DOUBLE AS "end" FROM (
    SELECT *, coalesce(sum(dur_ms + CASE WHEN (word_idx + 1) % 47 = 0 THEN 2000 ELSE 0 END) OVER (
        PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
    FROM (SELECT video_id, word_idx, word, (60 * length(word) + 40)::BIGINT AS dur_ms FROM (
        SELECT 'd' || doc_id AS video_id, unnest(w) AS word, unnest(range(len(w))) AS word_idx
        FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents))
      WHERE word <> ''))
"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    tokens = (
        texts_by_video(spark, sf)
        .select("video_id", F.posexplode_outer(_tokens(F.col("text"))).alias("word_idx", "word"))
        .where(F.col("word") != "")
        .withColumns({"word_idx": F.col("word_idx").cast("long"), "dur_ms": (60 * F.length("word") + 40).cast("long")})
    )
    pause = F.when((F.col("word_idx") + 1) % 47 == 0, 2000).otherwise(0)
    placed = running(
        tokens.withColumn("_blk", block_of("word_idx")),
        ["video_id"],
        ["word_idx"],
        {"start_ms": ("sum", F.col("dur_ms") + pause)},
        inclusive=False,
        many=many_words(spark, sf),
    )
    return placed.select(
        "video_id",
        "word_idx",
        "word",
        (F.col("start_ms") / 1000.0).alias("start"),
        ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end"),
    )


# ---- caption lines ----------------------------------------------------------------------------
SQL_VIEWS["v_lines"] = """
  SELECT *, coalesce(sum(dur_ms + CASE line_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 500 ELSE 2500 END) OVER (
        PARTITION BY video_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM (SELECT video_id, line_idx, line, (50 * length(line))::BIGINT AS dur_ms FROM (
    SELECT 'd' || doc_id AS video_id, unnest(w) AS line, unnest(range(len(w))) AS line_idx
    FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)))
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = texts_by_video(spark, sf).select(
        "video_id", F.posexplode_outer(F.split("text", "\n")).alias("line_idx", "line")
    ).withColumns({"line_idx": F.col("line_idx").cast("long"), "dur_ms": (50 * F.length("line")).cast("long")})
    gap = F.when(F.col("line_idx") % 3 == 0, 0).when(F.col("line_idx") % 3 == 1, 500).otherwise(2500)
    return running(
        raw.withColumn("_blk", block_of("line_idx")),
        ["video_id"],
        ["line_idx"],
        {"start_ms": ("sum", F.col("dur_ms") + gap)},
        inclusive=False,
        many=many_lines(spark, sf),
    ).drop("_blk")


def caption_events(spark: SparkSession, sf: str) -> DataFrame:
    """Caption events: each line in two pieces; every 11th event has no pieces at all."""
    half = F.floor(F.length("line") / 2).cast("int")
    pieces = F.array(
        F.struct(F.substring(F.col("line"), F.lit(1), half).alias("utf8")),
        F.struct(F.substring(F.col("line"), half + 1, F.length("line")).alias("utf8")),
    )
    return lines(spark, sf).select(
        "video_id",
        F.col("line_idx").alias("event_idx"),
        F.col("start_ms").alias("tStartMs"),
        F.col("dur_ms").alias("dDurationMs"),
        F.when(F.col("line_idx") % 11 != 10, pieces).alias("segs"),
    )


SQL_VIEWS["v_cues"] = """
  SELECT video_id, line_idx AS event_idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text,
         start_ms / 1000.0::DOUBLE AS start, dur_ms / 1000.0::DOUBLE AS duration
  FROM v_lines WHERE line_idx % 11 <> 10 AND regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''
"""

# ---- chapters ---------------------------------------------------------------------------------
SQL_VIEWS["v_raw_chapters"] = """
  SELECT s.video_id, s.seg_idx AS pos, m.duration,
         CASE WHEN s.conv_id % 5 = 1 AND s.seg_idx % 3 = 1 THEN 0.0::DOUBLE
              WHEN s.conv_id % 5 = 4 AND s.seg_idx = 1 THEN -1.0::DOUBLE ELSE s.start END AS start,
         CASE WHEN s.seg_idx % 2 = 0 THEN s.start + s.duration END AS "end",
         CASE WHEN s.conv_id % 5 = 0 AND s.seg_idx % 4 = 2 THEN '   ' ELSE s.text END AS title
  FROM v_segments s JOIN v_meta m USING (video_id)
"""


def raw_chapters(spark: SparkSession, sf: str) -> DataFrame:
    conv, pos = F.col("conv_id"), F.col("seg_idx")
    return (
        segments(spark, sf)
        .join(metadata(spark, sf).select("video_id", F.col("duration").alias("total")), "video_id")
        .select(
            "video_id",
            pos.alias("pos"),
            F.col("total").alias("duration"),
            F.when((conv % 5 == 1) & (pos % 3 == 1), 0.0)
            .when((conv % 5 == 4) & (pos == 1), -1.0)
            .otherwise(F.col("start"))
            .alias("start"),
            F.when(pos % 2 == 0, F.col("start") + F.col("duration")).alias("end"),
            F.when((conv % 5 == 0) & (pos % 4 == 2), "   ").otherwise(F.col("text")).alias("title"),
        )
    )


# ---- descriptions: document lines with time stamps ------------------------------------------------
SQL_VIEWS["v_descriptions"] = """
  SELECT 'd' || doc_id AS video_id, (65 * len(string_split(text, chr(10))))::DOUBLE AS duration,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN doc_id % 5 = 3 AND i = 1 THEN '00:07' WHEN doc_id % 5 = 2 AND i % 4 = 0 THEN '12:75'
           WHEN i > 56 THEN printf('%d:%02d:%02d', ((i - 1) * 65) // 3600, (((i - 1) * 65) // 60) % 60, ((i - 1) * 65) % 60)
           ELSE printf('%02d:%02d', ((i - 1) * 65) // 60, ((i - 1) * 65) % 60) END
      || CASE WHEN doc_id % 5 = 1 THEN ' - ' WHEN doc_id % 5 = 4 THEN '|' ELSE ' ' END || x), chr(10)) AS description
  FROM documents
"""


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")

    def two(number):
        return F.lpad(number.cast("string"), 2, "0")

    def stamped(line, i):
        seconds = (i * 65).cast("long")
        minutes = F.floor(seconds / 60).cast("long")
        stamp = (
            F.when((doc % 5 == 3) & (i == 0), "00:07")
            .when((doc % 5 == 2) & ((i + 1) % 4 == 0), "12:75")
            .when(
                i > 55,
                F.concat_ws(":", F.floor(seconds / 3600).cast("long").cast("string"), two(minutes % 60), two(seconds % 60)),
            )
            .otherwise(F.concat_ws(":", two(minutes), two(seconds % 60)))
        )
        mark = F.when(doc % 5 == 1, " - ").when(doc % 5 == 4, "|").otherwise(" ")
        return F.concat(stamp, mark, line)

    split = F.split("text", "\n")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), doc).alias("video_id"),
        (F.size(split) * 65).cast("double").alias("duration"),
        F.array_join(F.transform(split, stamped), "\n").alias("description"),
    )


# ---- translation responses: document lines as numbered answers ---------------------------------------
SQL_VIEWS["v_responses"] = """
  SELECT 'd' || doc_id AS video_id, doc_id % 9 AS prompt_index, doc_id, len(ls)::BIGINT AS expected,
    CASE WHEN doc_id % 6 = 5 THEN '  ' ELSE
      (CASE WHEN doc_id % 6 = 4 THEN '[batch_99]' WHEN doc_id % 12 = 1 THEN '[batch_' || (doc_id % 9 + 1) || '_r1_2]'
            ELSE '[batch_' || (doc_id % 9 + 1) || ']' END) || chr(10) ||
      array_to_string(list_transform(
         CASE WHEN doc_id % 6 = 3 THEN ls[1:len(ls) - 1] ELSE ls END,
         lambda x, i: (CASE WHEN doc_id % 6 = 2 AND i = 2 THEN 7 ELSE i END)::VARCHAR
                   || (CASE i % 4 WHEN 1 THEN '. ' WHEN 2 THEN ') ' WHEN 3 THEN ' : ' ELSE '- ' END)
                   || CASE WHEN doc_id % 24 = 0 AND i = 3 THEN '' ELSE x END), chr(10)) END AS response
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls
        FROM documents)
"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One numbered answer per document; some blank, mis-headed, short, reordered or with an empty line."""
    doc = F.col("doc_id")
    kept = table(spark, sf, "documents").select(
        "doc_id",
        F.filter(
            F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \n\t\r"))), lambda x: x != ""
        ).alias("ls"),
    )
    batch = F.concat(F.lit("[batch_"), doc % 9 + 1)
    header = (
        F.when(doc % 6 == 4, "[batch_99]").when(doc % 12 == 1, F.concat(batch, F.lit("_r1_2]"))).otherwise(F.concat(batch, F.lit("]")))
    )

    def numbered(line, i):
        n = i + 1
        number = F.when((doc % 6 == 2) & (n == 2), 7).otherwise(n).cast("string")
        mark = F.when(n % 4 == 1, ". ").when(n % 4 == 2, ") ").when(n % 4 == 3, " : ").otherwise("- ")
        return F.concat(number, mark, F.when((doc % 24 == 0) & (n == 3), "").otherwise(line))

    body = F.when(doc % 6 == 3, F.slice("ls", F.lit(1), F.greatest(F.size("ls") - 1, F.lit(0)))).otherwise(F.col("ls"))
    return kept.select(
        F.concat(F.lit("d"), doc).alias("video_id"),
        (doc % 9).alias("prompt_index"),
        "doc_id",
        F.size("ls").cast("long").alias("expected"),
        F.when(doc % 6 == 5, "  ")
        .otherwise(F.concat(header, F.lit("\n"), F.array_join(F.transform(body, numbered), "\n")))
        .alias("response"),
    )


# ---- vectors ----------------------------------------------------------------------------------
SQL_VIEWS["v_vectors"] = """
  SELECT 'l' || label AS video_id, vec_id AS chunk_id, embedding::DOUBLE[] AS vec FROM embeddings
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("l"), F.col("label")).alias("video_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector also asks its own video."""
    return vectors(spark, sf).select("video_id", F.col("chunk_id").alias("query_id"), "vec")


# ---- BM25 corpus and questions -----------------------------------------------------------------
SQL_VIEWS["v_corpus"] = "SELECT source AS video_id, doc_id AS chunk_id, text FROM documents"
SQL_VIEWS["v_questions"] = "SELECT item_id AS query_id, 'src' || (item_id % 20) AS video_id, text AS question FROM benchmark"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), "text"
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("video_id"),
        F.col("text").alias("question"),
    )


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


# ---- events -----------------------------------------------------------------------------------
SQL_VIEWS["v_events"] = """
  SELECT 'u' || user_id AS video_id, event_id, event_type, value, props, ts, epoch_us(ts) AS ts_us FROM events
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("video_id"),
        "event_id",
        "event_type",
        "value",
        "props",
        "ts",
        micros("ts").alias("ts_us"),
    )


# ---- samples: event values in time order ----------------------------------------------------------
SQL_VIEWS["v_samples"] = """
  SELECT clip_id, i, CASE WHEN (i // 12) % 3 = 1 THEN value / 100000.0::DOUBLE ELSE value / 100.0::DOUBLE END AS x FROM (
    SELECT video_id AS clip_id, value, row_number() OVER (PARTITION BY video_id ORDER BY ts_us, event_id) - 1 AS i FROM v_events)
"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Mono samples per clip; blocks are days, so a busy user spreads over tasks."""
    day = F.floor(F.col("ts_us") / (DAY * 1_000_000)).cast("long")
    placed = dense_position(events(spark, sf), ["video_id"], ["ts_us", "event_id"], day, "i")
    quiet = F.floor(F.col("i") / 12) % 3 == 1
    return placed.select(
        F.col("video_id").alias("clip_id"),
        "i",
        F.when(quiet, F.col("value") / 100000.0).otherwise(F.col("value") / 100.0).alias("x"),
    )


# ---- web results ------------------------------------------------------------------------------
SQL_VIEWS["v_search"] = """
  SELECT page_id // 8 AS query_id, page_id AS rank, CASE WHEN page_id % 13 = 5 THEN '' ELSE url END AS url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS content FROM pages
"""


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 8).cast("long").alias("query_id"),
        F.col("page_id").alias("rank"),
        F.when(F.col("page_id") % 13 == 5, "").otherwise(F.col("url")).alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ").alias("content"),
    )
