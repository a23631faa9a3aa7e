"""Scalar columns over whole tables: text choice, labels, density, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.catalog import sql_bits as sb
from cuewright.catalog import views
from cuewright.catalog.registry import SQL_VIEWS, query
from cuewright.functions import numbers as num
from cuewright.functions import text as txt

# ---- ids and text choice -----------------------------------------------------------------------
SQL_VIEWS["v_urls"] = """
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN ' ' || substr(md5(url), 1, 11) || ' '
    WHEN 1 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=4'
    WHEN 2 THEN 'https://youtu.be/' || substr(md5(url), 1, 11)
    WHEN 3 THEN 'https://youtube.com/shorts/' || substr(md5(url), 1, 11) || '?x=1'
    WHEN 4 THEN 'https://www.youtube.com/embed/' || substr(md5(url), 1, 11)
    WHEN 5 THEN 'https://www.youtube.com/live/' || substr(md5(url), 1, 9)
    WHEN 6 THEN substr(md5(url), 1, 12) ELSE url END AS given FROM pages
"""


def _urls(spark, sf):
    key, kind = F.substring(F.md5("url"), 1, 11), F.col("page_id") % 8
    shapes = [
        F.concat(F.lit(" "), key, F.lit(" ")),
        F.concat(F.lit("https://www.youtube.com/watch?v="), key, F.lit("&t=4")),
        F.concat(F.lit("https://youtu.be/"), key),
        F.concat(F.lit("https://youtube.com/shorts/"), key, F.lit("?x=1")),
        F.concat(F.lit("https://www.youtube.com/embed/"), key),
        F.concat(F.lit("https://www.youtube.com/live/"), F.substring(F.md5("url"), 1, 9)),
        F.substring(F.md5("url"), 1, 12),
        F.col("url"),
    ]
    given = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        given = F.when(kind == i, shape).otherwise(given)
    return views.table(spark, sf, "pages").select("page_id", given.alias("given"))


@query(
    "extract_video_id",
    f"""SELECT page_id, video_id, CASE WHEN video_id IS NULL THEN 'no_video_id' END AS error FROM (
      SELECT page_id, CASE WHEN regexp_matches({sb.strip('given')}, '^[A-Za-z0-9_-]{{11}}$') THEN {sb.strip('given')}
        ELSE nullif(regexp_extract(given, '(?:youtube\\.com/(?:watch\\?v=|shorts/|embed/|live/)|youtu\\.be/)([A-Za-z0-9_-]{{11}})', 1), '') END AS video_id
      FROM v_urls)""",
)
def extract_video_id(spark, sf):
    vid = txt.video_id(F.col("given"))
    return _urls(spark, sf).select(
        "page_id", vid.alias("video_id"), F.when(vid.isNull(), "no_video_id").alias("error")
    )


@query("segment_text", f"SELECT video_id, seg_idx, {sb.seg_text()} AS text FROM v_segments WHERE {sb.seg_text()} <> ''")
def segment_text(spark, sf):
    return (
        views.segments(spark, sf)
        .select("video_id", "seg_idx", txt.segment_text(F.col("text_vi"), F.col("text_tts"), F.col("text")).alias("text"))
        .where(F.col("text") != "")
    )


@query(
    "display_text",
    f"""SELECT video_id, seg_idx, {sb.strip("replace(text, chr(10), ' ')")} AS en,
     CASE WHEN text_vi <> '' THEN {sb.strip('text_vi')} ELSE {sb.strip("coalesce(text_tts, '')")} END AS vi FROM v_segments""",
)
def display_text(spark, sf):
    cols = F.col("text_vi"), F.col("text_tts"), F.col("text")
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", txt.display_text(*cols, "en").alias("en"), txt.display_text(*cols, "vi").alias("vi")
    )


@query(
    "reference_text",
    f"""SELECT video_id, seg_idx, {sb.strip("coalesce(nullif(t, ''), nullif(text_tts, ''), nullif(text_vi, ''), 'src ' || role)")} AS text
     FROM (SELECT *, CASE WHEN seg_idx % 2 = 0 THEN text ELSE '' END AS t FROM v_segments)""",
)
def reference_text(spark, sf):
    text = F.when(F.col("seg_idx") % 2 == 0, F.col("text")).otherwise("")
    parts = F.array(F.lit("src"), F.lit(""), F.col("role"))
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", txt.reference_text(text, F.col("text_tts"), F.col("text_vi"), parts).alias("text")
    )


@query(
    "fmt_time",
    f"SELECT video_id, word_idx, {sb.fmt_time('start')} AS label, {sb.cue_time('start')} AS cue FROM v_words",
)
def fmt_time(spark, sf):
    return views.words(spark, sf).select(
        "video_id", "word_idx", txt.fmt_time(F.col("start")).alias("label"), txt.cue_time(F.col("start")).alias("cue")
    )


@query(
    "detect_language",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text || ' ' || source, '[{fv.VIETNAMESE_LETTERS}]') THEN 'vi' ELSE 'en' END AS lang
     FROM documents""",
)
def detect_language(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", txt.detect_language(F.col("text"), F.col("source")).alias("lang")
    )


# ---- numbers and labels ----------------------------------------------------------------------
@query(
    "percent_to_gain",
    """SELECT o_orderkey, round(pow(least(greatest(coalesce(p, 40.0::DOUBLE), 0), 100) / 100.0::DOUBLE, 2), 6) AS gain,
        coalesce(p, 0.0::DOUBLE) AS stored_percent
     FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice / 4000.0::DOUBLE - 10, 2) END AS p FROM orders)""",
)
def percent_to_gain(spark, sf):
    percent = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 4000.0 - 10, 2))
    return views.table(spark, sf, "orders").select(
        "o_orderkey", num.percent_to_gain(percent).alias("gain"), num.stored_voice_percent(percent).alias("stored_percent")
    )


SQL_VIEWS["v_presets"] = """
  SELECT event_id, CASE event_type WHEN 'click' THEN 'cpu_small' WHEN 'view' THEN 'GPU_turbo' WHEN 'error' THEN ''
     WHEN 'signup' THEN NULL ELSE 'other' END AS preset,
     CASE user_id % 4 WHEN 0 THEN 'omnivoice' WHEN 1 THEN 'Supertonic' WHEN 2 THEN '' END AS engine FROM events
"""


def _presets(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id") % 4
    return views.table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", "cpu_small")
        .when(kind == "view", "GPU_turbo")
        .when(kind == "error", "")
        .when(kind == "purchase", "other")
        .alias("preset"),
        F.when(user == 0, "omnivoice").when(user == 1, "Supertonic").when(user == 2, "").alias("engine"),
    )


@query(
    "run_mode",
    """SELECT event_id, CASE WHEN p LIKE 'cpu%' THEN 'cpu' WHEN p LIKE 'gpu%' THEN 'gpu' WHEN e = 'omnivoice' THEN 'gpu'
        WHEN e = 'supertonic' THEN 'cpu' ELSE p END AS mode
     FROM (SELECT event_id, lower(coalesce(nullif(preset, ''), 'auto')) AS p, lower(coalesce(engine, '')) AS e FROM v_presets)""",
)
def run_mode(spark, sf):
    return _presets(spark, sf).select("event_id", num.run_mode(F.col("preset"), F.col("engine"), "auto").alias("mode"))


PRESETS = [("cpu_small", "faster", "small.en", "cpu", "int8"), ("GPU_turbo", None, "turbo", "cuda", None)]


@query(
    "asr_descriptor",
    """SELECT event_id, concat_ws(':', coalesce(t.engine, 'faster'), coalesce(t.model, 'small.en'), coalesce(t.device, 'unknown'),
        coalesce(t.compute, 'unknown')) AS descriptor
     FROM v_presets p LEFT JOIN (VALUES ('cpu_small', 'faster', 'small.en', 'cpu', 'int8'), ('GPU_turbo', NULL, 'turbo', 'cuda', NULL))
        t(id, engine, model, device, compute) ON coalesce(nullif(p.preset, ''), 'cpu_small') = t.id""",
)
def asr_descriptor(spark, sf):
    from cuewright.operators.catalogue import asr_descriptor as descriptor

    table = spark.createDataFrame(PRESETS, "id string, engine string, model string, device string, compute string")
    return descriptor(_presets(spark, sf).drop("engine"), table, "preset", default_preset="cpu_small", default_engine="faster", default_model="small.en").select(
        "event_id", "descriptor"
    )


@query(
    "clean_nulls",
    """SELECT event_id, nullif(nullif(v, ''), 'NaN') AS cleaned, coalesce(try_cast(nullif(nullif(v, ''), 'NaN') AS DOUBLE), 0.0) AS number
     FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL
            ELSE event_id::VARCHAR || '.5' END AS v FROM events)""",
)
def clean_nulls(spark, sf):
    m = F.col("event_id") % 5
    v = F.when(m == 0, "").when(m == 1, "NaN").when(m == 2, "n/a").when(m == 4, F.concat(F.col("event_id"), F.lit(".5")))
    return views.table(spark, sf, "events").select(
        "event_id", num.clean_null(v).alias("cleaned"), num.numeric(v).alias("number")
    )


@query(
    "duration_min",
    """SELECT video_id, round(try_cast(d AS DOUBLE) / 60.0::DOUBLE, 3) AS duration_min FROM (
        SELECT video_id, CASE n_segments % 4 WHEN 1 THEN 'unknown' ELSE duration::VARCHAR END AS d FROM v_meta)""",
)
def duration_min(spark, sf):
    text = F.when(F.col("n_segments") % 4 == 1, "unknown").otherwise(F.col("duration").cast("string"))
    return views.metadata(spark, sf).select("video_id", num.duration_min(text).alias("duration_min"))


@query(
    "labels_lookup",
    """SELECT event_id, CASE engine WHEN 'omnivoice' THEN 'OmniVoice - GPU' WHEN 'supertonic' THEN 'Supertonic - CPU'
        ELSE coalesce(nullif(engine, ''), 'unknown') END AS engine_label,
       CASE WHEN engine = 'supertonic' THEN CASE model WHEN 'M5' THEN 'Giọng nam' WHEN 'F5' THEN 'Giọng nữ' END
            WHEN engine = 'omnivoice' THEN CASE model WHEN 'source' THEN 'Giọng gốc video' WHEN 'M5' THEN 'Voice five' END END AS voice_label
     FROM (SELECT event_id, lower(engine) AS engine, CASE event_id % 3 WHEN 0 THEN 'M5' WHEN 1 THEN 'F5' ELSE 'source' END AS model
           FROM v_presets)""",
)
def labels_lookup(spark, sf):
    model = F.when(F.col("event_id") % 3 == 0, "M5").when(F.col("event_id") % 3 == 1, "F5").otherwise("source")
    engine = F.lower("engine")
    return _presets(spark, sf).select(
        "event_id",
        num.engine_label(engine).alias("engine_label"),
        num.voice_label(engine, model, model, {"M5": "Voice five"}, "source").alias("voice_label"),
    )


@query(
    "bounded_override",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 4 BETWEEN 50 AND 150 THEN (l_quantity * 4)::BIGINT ELSE 90 END AS batch_size
     FROM lineitem""",
)
def bounded_override(spark, sf):
    wanted = (F.col("l_quantity") * 4).cast("long")
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        num.bounded_override(wanted, 50, 150, fv.MANUAL_BATCH_SIZE).alias("batch_size"),
    )


@query(
    "tier_lookup",
    """SELECT o_orderkey, arg_max(t.v, t.threshold) AS tier FROM orders LEFT JOIN
       (VALUES (50000.0::DOUBLE, 'tiny'), (100000.0, 'base'), (200000.0, 'small'), (350000.5, 'turbo')) t(threshold, v) ON o_totalprice >= t.threshold
     GROUP BY o_orderkey""",
)
def tier_lookup(spark, sf):
    tiers = {50000.0: "tiny", 100000.0: "base", 200000.0: "small", 350000.5: "turbo"}
    return views.table(spark, sf, "orders").select("o_orderkey", num.tier_of(F.col("o_totalprice"), tiers).alias("tier"))


@query(
    "min_threshold",
    "SELECT o_orderpriority AS option_id, min(o_totalprice) AS min_threshold FROM orders GROUP BY o_orderpriority",
)
def min_threshold(spark, sf):
    from cuewright.operators.catalogue import min_threshold as lowest

    table = views.table(spark, sf, "orders")
    return lowest(table.select(F.col("o_totalprice").alias("threshold"), F.col("o_orderpriority").alias("option_id")))


# ---- density ---------------------------------------------------------------------------------
@query("spoken_units", f"SELECT doc_id, {sb.units('text')} AS units FROM documents")
def spoken_units(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", txt.spoken_units(F.col("text")).alias("units"))


@query(
    "natural_duration",
    f"SELECT video_id, seg_idx, round({sb.units('text')} / {fv.TARGET_UNITS_PER_SEC}::DOUBLE, 6) AS seconds FROM v_segments",
)
def natural_duration(spark, sf):
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", F.round(num.natural_duration(txt.spoken_units(F.col("text"))), 6).alias("seconds")
    )


@query(
    "density_check",
    f"""SELECT video_id, seg_idx, {sb.density_cols('text', 'd')} FROM (SELECT *, CASE seg_idx % 4 WHEN 0 THEN start_ms / 5000.0::DOUBLE
        WHEN 1 THEN duration WHEN 2 THEN greatest(0.1::DOUBLE, (20 + seg_idx) / {fv.SOURCE_UNITS_PER_SEC}::DOUBLE) END AS d FROM v_segments)""",
)
def density_check(spark, sf):
    m = F.col("seg_idx") % 4
    given = F.when(m == 0, F.col("start_ms") / 5000.0).when(m == 1, F.col("duration"))
    budget = F.when(m == 2, 20 + F.col("seg_idx"))
    counted = views.segments(spark, sf).withColumn("units", txt.spoken_units(F.col("text")))
    report = counted.select("video_id", "seg_idx", num.density(F.col("units"), given, budget).alias("r"))
    fields = "duration density min_units target_units base_max_units tolerance_units max_units".split()
    return report.select(
        "video_id",
        "seg_idx",
        *[F.col(f"r.{f}").alias(f) for f in fields],
        (F.size("r.warnings") > 0).alias("over_budget"),
    )


@query(
    "budget_label",
    """SELECT video_id, seg_idx, b AS budget, '[' || greatest(1, floor(d * 3.2::DOUBLE)::BIGINT) || '-' || (base + greatest(3, ceil(base * 0.4::DOUBLE)::BIGINT)) || ' tiếng]' AS label
     FROM (SELECT *, greatest(2, floor(d * 5.2::DOUBLE)::BIGINT) AS base FROM (SELECT *, greatest(0.1::DOUBLE, b / 6.0::DOUBLE) AS d FROM (
       SELECT video_id, seg_idx, greatest(2, round_even(duration * 6.0::DOUBLE, 0)::BIGINT) AS b FROM v_segments)))""",
)
def budget_label(spark, sf):
    budget = num.syllable_budget(F.col("duration"))
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", budget.alias("budget"), num.budget_label(budget).alias("label")
    )


@query(
    "adaptive_speed",
    f"""SELECT video_id, seg_idx, round(least(1.5, greatest(0.9, 1.0::DOUBLE + greatest(0.0, CASE WHEN coalesce(text_tts, '') <> '' THEN
        ({sb.units('text_tts')} / 4.5::DOUBLE) / greatest(0.1::DOUBLE, duration) ELSE 1.0 END - 1.0) / 4.0::DOUBLE)), 6) AS speed FROM v_segments""",
)
def adaptive_speed(spark, sf):
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", F.round(num.adaptive_speed(F.col("text_tts"), F.col("duration")), 6).alias("speed")
    )


@query(
    "generation_slot",
    f"""SELECT video_id, seg_idx, round(greatest(0.2::DOUBLE, slot + greatest(0.3::DOUBLE, greatest(0.0::DOUBLE, n - slot) * 1.2::DOUBLE)), 6) AS seconds FROM (
      SELECT video_id, seg_idx, greatest(0.2::DOUBLE, duration) AS slot, {sb.units('text_tts')} / 4.5::DOUBLE AS n FROM v_segments)""",
)
def generation_slot(spark, sf):
    return views.segments(spark, sf).select(
        "video_id", "seg_idx", F.round(num.generation_slot(F.col("text_tts"), F.col("duration")), 6).alias("seconds")
    )


@query(
    "fit_report",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(raw / 1000.0::DOUBLE, 3) AS raw_duration, round(slot / 1000.0::DOUBLE, 3) AS target_duration,
       CASE WHEN raw > slot AND slot > 0 THEN round(raw / slot::DOUBLE, 3) ELSE 1.0 END AS fit_ratio,
       CASE WHEN slot <= 0 THEN 0.0 ELSE round(residual / 1000.0::DOUBLE, 3) END AS trimmed_duration,
       CASE WHEN slot <= 0 THEN 'bad_slot' ELSE concat_ws(',', CASE WHEN raw > slot THEN CASE WHEN raw / slot::DOUBLE > 1.75 THEN 'tempo_strong'
           WHEN raw / slot::DOUBLE > 1.35 THEN 'tempo_fast' WHEN raw / slot::DOUBLE > 1.15 THEN 'tempo_light' END END,
           CASE WHEN round(residual / 1000.0::DOUBLE, 3) > 0.03 THEN 'residual_trim' END) END AS warnings
     FROM (SELECT *, (l_quantity * 100)::BIGINT AS raw, (l_partkey % 30 * 100)::BIGINT AS slot, (l_suppkey % 50)::BIGINT AS residual FROM lineitem)""",
)
def fit_report(spark, sf):
    report = num.fit_report(
        (F.col("l_quantity") * 100).cast("long"), F.col("l_partkey") % 30 * 100, F.col("l_suppkey") % 50, 1000
    )
    fields = "raw_duration target_duration fit_ratio trimmed_duration".split()
    return (
        views.table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", report.alias("r"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            *[F.col(f"r.{f}").alias(f) for f in fields],
            F.array_join("r.warnings", ",").alias("warnings"),
        )
    )


# ---- generated text -----------------------------------------------------------------------------
SQL_VIEWS["v_markdown"] = """
  SELECT doc_id, '## ' || replace(replace(text, '. ', '.' || chr(10) || '* **'), ', ', '**' || chr(10) || chr(10) || chr(10) || '__') || ' \\(x+1\\) ' AS md
  FROM documents
"""


def markdown(spark, sf):
    body = F.replace(
        F.replace(F.col("text"), F.lit(". "), F.lit(".\n* **")), F.lit(", "), F.lit("**\n\n\n__")
    )
    return views.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("## "), body, F.lit(" \\(x+1\\) ")).alias("md")
    )


_BOLD = "regexp_replace({}, '\\*\\*(.*?)\\*\\*', '\\1', 'g')"
_HEAD = "regexp_replace({}, '(?m)^#{{1,6}}\\s*', '', 'g')"
_GAPS = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_SUMMARY = _GAPS.format(
    "regexp_replace(" + _HEAD.format(_BOLD.format(sb.strip("md"))) + ", '(?m)^\\s*[*•]\\s+', '- ', 'g')"
)
_ANSWER = _GAPS.format(
    _HEAD.format(
        "regexp_replace(regexp_replace("
        + _BOLD.format(sb.strip("md"))
        + ", '__(.*?)__', '\\1', 'g'), '\\\\\\((.*?)\\\\\\)', '\\1', 'g')"
    )
)


@query("clean_markdown", f"SELECT doc_id, {_SUMMARY} AS summary, {_ANSWER} AS answer FROM v_markdown")
def clean_markdown(spark, sf):
    return markdown(spark, sf).select(
        "doc_id", txt.clean_summary(F.col("md")).alias("summary"), txt.clean_answer(F.col("md")).alias("answer")
    )


@query(
    "stage_progress",
    """SELECT event_id, CASE k WHEN 0 THEN 100 WHEN 1 THEN 0 WHEN 2 THEN least(100, (event_id % 130)) WHEN 3 THEN 100 WHEN 4 THEN 0 ELSE 0 END::BIGINT AS percent,
       CASE WHEN k = 4 THEN event_id % 40 END AS done, CASE WHEN k = 4 THEN greatest(1, event_id % 50) END AS total,
       CASE WHEN k = 4 THEN least(100, floor((event_id % 40) / greatest(1, event_id % 50)::DOUBLE * 100 + 0.5)::BIGINT) END AS pct
     FROM (SELECT event_id, event_id % 6 AS k FROM events)""",
)
def stage_progress(spark, sf):
    k, e = F.col("event_id") % 6, F.col("event_id")
    stage = (
        F.when(k == 0, "Whisper STT thành công")
        .when(k == 1, "Đang chuẩn bị nhận diện giọng nói 45%")
        .when(k == 2, F.concat(F.lit("Đang nhận diện giọng nói bằng Whisper "), e % 130, F.lit("%")))
        .when(k == 3, "Tạo prompts")
        .when(k == 4, F.concat(F.lit("Tổng hợp giọng nói "), e % 40, F.lit("/"), e % 50))
        .otherwise("Khác")
    )
    done = txt.synthesis_progress(stage)
    return views.table(spark, sf, "events").select(
        "event_id",
        txt.stage_progress(stage).alias("percent"),
        done["done"].alias("done"),
        done["total"].alias("total"),
        done["pct"].alias("pct"),
    )


@query(
    "cache_usage",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN nullif(event_id, 0) WHEN 1 THEN event_id + 1 WHEN 2 THEN event_id + 2 END::BIGINT AS hit_tokens,
       CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::BIGINT END AS miss_tokens FROM events""",
)
def cache_usage(spark, sf):
    from cuewright.functions.usage import cache_usage as usage

    e, m = F.col("event_id"), F.col("event_id") % 4
    k = F.get_json_object("props", "$.k")
    response = F.concat(
        F.when(m == 0, F.concat(F.lit('{"usage_metadata":{"input_token_details":{"cache_read":'), e, F.lit("}},")))
        .when(m == 1, F.lit("{"))
        .otherwise(F.lit('{"usage_metadata":{"input_token_details":{"cache_read":0}},')),
        F.when(
            m == 1,
            F.concat(F.lit('"response_metadata":{"token_usage":{"prompt_tokens_details":{"cached_tokens":'), e + 1, F.lit("}}}}")),
        )
        .when(
            m == 2,
            F.concat(
                F.lit('"response_metadata":{"usage":{"prompt_cache_hit_tokens":'), e + 2,
                F.lit(',"prompt_cache_miss_tokens":'), k, F.lit("}}}"),
            ),
        )
        .when(
            m == 0,
            F.concat(F.lit('"response_metadata":{"token_usage":{"prompt_cache_miss_tokens":'), k, F.lit("}}}")),
        )
        .otherwise(F.lit('"response_metadata":{}}')),
    )
    usage_cols = usage(response)
    return views.table(spark, sf, "events").select(
        "event_id", usage_cols["hit_tokens"].alias("hit_tokens"), usage_cols["miss_tokens"].alias("miss_tokens")
    )


@query(
    "flatten_content",
    f"""SELECT video_id, seg_idx, CASE seg_idx % 3 WHEN 0 THEN {sb.strip('text')}
        ELSE {sb.strip("text || chr(10) || role")} END AS content FROM v_segments""",
)
def flatten_content(spark, sf):
    m, text, role = F.col("seg_idx") % 3, F.col("text"), F.col("role")
    as_objects = F.to_json(F.array(F.struct(text.alias("text")), F.struct(F.lit("").alias("text")), F.struct(role.alias("text"))))
    as_strings = F.to_json(F.array(text, F.lit(""), role))
    raw = F.when(m == 0, text).when(m == 1, as_objects).otherwise(as_strings)
    return views.segments(spark, sf).select("video_id", "seg_idx", txt.flatten_content(raw).alias("content"))


@query(
    "pick_thumbnail",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '?avatar' WHEN 1 THEN url || '?900' WHEN 2 THEN url || '?first' ELSE '' END AS thumbnail FROM pages""",
)
def pick_thumbnail(spark, sf):
    m = F.col("page_id") % 4

    def pic(name, suffix, width, height):
        return F.struct(
            F.lit(name).alias("id"),
            F.concat(F.col("url"), F.lit(suffix)).alias("url"),
            F.lit(width).alias("width"),
            F.lit(height).alias("height"),
        )

    wide, small, big = pic("banner", "?wide", 1060, 175), pic("1", "?88", 88, 88), pic("2", "?900", 900, 900)
    pictures = (
        F.when(m == 0, F.array(wide, big, pic("channel_Avatar", "?avatar", 10, 20), small))
        .when(m == 1, F.array(wide, small, big))
        .when(m == 2, F.array(pic("a", "?first", 300, 300), pic("b", "?second", 300, 300)))
        .otherwise(F.array(wide))
    )
    return views.table(spark, sf, "pages").select("page_id", txt.pick_thumbnail(pictures).alias("thumbnail"))


# ---- web results -------------------------------------------------------------------------------
_SHAPED = f"""
  SELECT query_id, rank, pos, {sb.strip('title')} AS title, {sb.strip('url')} AS url,
         CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE url END AS domain,
         substr({sb.strip('content')}, 1, 300) AS snippet
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM v_search)
  WHERE pos <= 5 AND url <> ''
"""
SQL_VIEWS["v_shaped"] = _SHAPED


@query("shape_search_results", "SELECT query_id, rank, title, url, domain, snippet FROM v_shaped")
def shape_search_results(spark, sf):
    from cuewright.operators.retrieval import shape_search_results as shape

    return shape(views.search_results(spark, sf), n=5).select("query_id", "rank", "title", "url", "domain", "snippet")


@query(
    "format_search_results",
    """SELECT query_id, string_agg('[WEB-' || i || '] ' || title || chr(10) || 'Domain: ' || domain || chr(10) || 'URL: ' || url || chr(10)
         || 'Snippet: ' || snippet, chr(10) || chr(10) ORDER BY i) AS block
     FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM v_shaped) GROUP BY query_id""",
)
def format_search_results(spark, sf):
    from cuewright.operators import retrieval

    return retrieval.format_search_results(retrieval.shape_search_results(views.search_results(spark, sf), n=5))


# ---- small checks ------------------------------------------------------------------------------
@query(
    "merge_warnings",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'slow,' || event_type || ',fast' WHEN 1 THEN event_type || ',slow,fast' ELSE 'fast,slow' END AS warnings FROM events""",
)
def merge_warnings(spark, sf):
    from cuewright.operators.timing import merge_warnings as merge

    m, kind = F.col("event_id") % 3, F.col("event_type")
    existing = F.when(m == 0, F.array(F.lit("slow"), kind)).when(m == 1, F.array(kind, F.lit("slow")))
    new = F.when(m == 2, F.array(F.lit("fast"), F.lit("slow"))).otherwise(F.array(kind, F.lit("fast"), F.lit("slow")))
    return views.table(spark, sf, "events").select("event_id", F.array_join(merge(existing, new), ",").alias("warnings"))


@query(
    "validate_map_rows",
    """SELECT event_id, CASE WHEN a <> '' AND b <> '' THEN a END AS source, CASE WHEN a <> '' AND b <> '' THEN b END AS spoken,
       CASE WHEN (a = '') <> (b = '') THEN 'incomplete_row:' || (event_id + 1) END AS error
     FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' ELSE event_type END AS a, CASE event_id % 4 WHEN 0 THEN '' ELSE 's' || event_type END AS b FROM events)
     WHERE NOT (a = '' AND b = '')""",
)
def validate_map_rows(spark, sf):
    from cuewright.operators.validation import validate_map_rows as validate

    rows = views.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.col("event_type"), F.lit(" "))).alias("source"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(" s"), F.col("event_type"))).alias("spoken"),
    )
    return validate(rows, "event_id").select("event_id", "source", "spoken", "error")
