"""Translation flow: spoken forms, batches, prompts, answers, retries, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.catalog import sql_bits as sb
from cuewright.catalog import views
from cuewright.catalog.q_timing import line_segments
from cuewright.catalog.registry import SQL_VIEWS, query
from cuewright.functions import spoken
from cuewright.operators import catalogue, chapters, translation, validation

GLOSSARY = fv.BUILTIN_GLOSSARY


def technical_lines(spark, sf):
    """Document lines mixed with the technical tokens the cascade is about."""
    i = F.col("line_idx")
    extra = (
        F.when(i % 6 == 0, F.concat(F.lit("GPT-"), i % 9, F.lit(" cần "), i, F.lit(" GB RAM, ")))
        .when(i % 6 == 1, F.concat(F.lit("docker ps -a node:"), i % 30, F.lit("-alpine ")))
        .when(i % 6 == 2, F.concat(F.lit("f(x) = w + "), i * 1234 + 0, F.lit(".5% ")))
        .when(i % 6 == 3, F.lit("/app/src/main.py “NASA” 'x' "))
        .when(i % 6 == 4, F.concat(F.lit("$"), i * 1001, F.lit(" CLI API --help ")))
        .otherwise("")
    )
    return views.lines(spark, sf).select(
        "video_id",
        F.col("line_idx").alias("seg_idx"),
        F.concat(extra, F.col("line")).alias("text"),
        (F.col("dur_ms") / 1000.0).alias("duration"),
    )


SQL_VIEWS["v_technical"] = """
  SELECT video_id, line_idx AS seg_idx, CASE line_idx % 6
    WHEN 0 THEN 'GPT-' || (line_idx % 9) || ' cần ' || line_idx || ' GB RAM, ' WHEN 1 THEN 'docker ps -a node:' || (line_idx % 30) || '-alpine '
    WHEN 2 THEN 'f(x) = w + ' || (line_idx * 1234) || '.5% ' WHEN 3 THEN '/app/src/main.py “NASA” ''x'' '
    WHEN 4 THEN '$' || (line_idx * 1001) || ' CLI API --help ' ELSE '' END || line AS text FROM v_lines
"""
_WORD_CLASS = r"\p{L}\p{N}_"
_BLANK_CLASS = "".join(rf"\x{{{ord(c):x}}}" for c in fv.WHITESPACE)


def canonical_sql(text: str) -> str:
    """Paired quotes are set aside, since DuckDB's patterns cannot look around; then all other quotes go."""
    double, single = fv.QUOTES_TO_DOUBLE + '"', fv.QUOTES_TO_SINGLE
    blanks, quotes = " " * len(double), "''" * len(single)
    plain = f"translate(nfc_normalize({text}), '{double}{single}', '{blanks}{quotes}')"
    for _ in range(2):  # twice: neighbouring pairs share a letter
        plain = rf"regexp_replace({plain}, '([{_WORD_CLASS}])''([{_WORD_CLASS}])', '\1' || chr(2) || '\2', 'g')"
    bare = f"replace(replace({plain}, '''', ' '), chr(2), '''')"
    return rf"regexp_replace(trim(regexp_replace({bare}, '[{_BLANK_CLASS}]+', ' ', 'g')), ' ([,.;:!?])', '\1', 'g')"


def glossary_sql(text: str, words: dict) -> str:
    for key in sorted(words, key=len, reverse=True):
        for _ in range(2):
            text = rf"regexp_replace({text}, '(^|[^{_WORD_CLASS}])(?i:{key})($|[^{_WORD_CLASS}])', '\1{words[key]}\2', 'g')"
    return text


@query("canonicalize_text", f"SELECT video_id, seg_idx, {canonical_sql('text')} AS text FROM v_technical")
def canonicalize_text(spark, sf):
    return technical_lines(spark, sf).select(
        "video_id", "seg_idx", spoken.canonicalize_text(F.col("text")).alias("text")
    )


def number_words_sql(number: str) -> str:
    """An integer column in words: groups of three digits, the first without its leading zeros."""
    names = "[" + ", ".join(f"'{n}'" for n in fv.DIGIT_NAMES) + "]"
    scales = "[" + ", ".join(f"'{n}'" for n in fv.SCALE_NAMES) + "]"
    digits = f"abs({number})::VARCHAR"
    groups = f"((length({digits}) + 2) // 3)"
    h, t, o = (f"substr(g, {i}, 1)::INT" for i in (1, 2, 3))
    special = " ".join(f"WHEN {k} THEN '{v}'" for k, v in fv.ONES_AFTER_TENS.items())
    words = f"""concat_ws(' ',
        CASE WHEN {h} > 0 OR i > 1 THEN {names}[{h} + 1] || ' trăm' END,
        CASE WHEN ({h} > 0 OR i > 1) AND {t} = 0 AND {o} > 0 THEN 'lẻ' END,
        CASE {t} WHEN 0 THEN NULL WHEN 1 THEN 'mười' ELSE {names}[{t} + 1] || ' mươi' END,
        CASE WHEN {o} = 0 THEN NULL WHEN {t} = 0 THEN {names}[{o} + 1]
             WHEN {t} = 1 THEN CASE {o} WHEN 5 THEN '{fv.ONES_AFTER_TENS[5]}' ELSE {names}[{o} + 1] END
             ELSE CASE {o} {special} ELSE {names}[{o} + 1] END END,
        nullif({scales}[{groups} - i + 1], ''))"""
    cut = f"list_transform(range({groups}), lambda i: substr(lpad({digits}, ({groups} * 3)::INT, '0'), (i * 3 + 1)::INT, 3))"
    said = f"array_to_string(list_filter(list_transform({cut}, lambda g, i: CASE WHEN g = '000' THEN NULL ELSE {words} END), lambda x: x IS NOT NULL), ' ')"
    return f"CASE WHEN {number} = 0 THEN '{fv.DIGIT_NAMES[0]}' ELSE CASE WHEN {number} < 0 THEN 'âm ' ELSE '' END || {said} END"


@query(
    "spell_number",
    f"""SELECT o_orderkey, {number_words_sql('o_orderkey')} AS key_words, {number_words_sql('price')} AS price_words
        FROM (SELECT o_orderkey, trunc(o_totalprice * 100)::BIGINT - 20000000 AS price FROM orders)""",
)
def spell_number(spark, sf):
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        spoken.spell_number(F.col("o_orderkey")).alias("key_words"),
        spoken.spell_number((F.col("o_totalprice") * 100).cast("long") - 20_000_000).alias("price_words"),
    )


@query("pronounce")
def pronounce(spark, sf):
    rows = views.segments(spark, sf)
    own = F.create_map(F.lit(" un "), F.lit("một"), F.lit("the"), F.lit("đờ"), F.lit("de la"), F.lit("$1 đờ"), F.lit("x"), F.lit(" "))
    preview = spoken.pronounce(F.col("text"), own, words_only=True)
    return rows.select("video_id", "seg_idx", spoken.pronounce(F.col("text"), own).alias("text"), preview.alias("preview"))


@query("apply_glossary", f"SELECT video_id, seg_idx, {glossary_sql('text', GLOSSARY)} AS text FROM v_technical")
def apply_glossary(spark, sf):
    mapping = F.create_map(*[F.lit(x) for pair in GLOSSARY.items() for x in pair])
    return technical_lines(spark, sf).select(
        "video_id", "seg_idx", spoken.pronounce(F.col("text"), mapping).alias("text")
    )


@query("normalize_text")
def normalize_text(spark, sf):
    rows = technical_lines(spark, sf).withColumn("n", spoken.normalize_text(F.col("text"), GLOSSARY))
    return rows.select("video_id", "seg_idx", F.col("n.text").alias("text"), F.array_join("n.rules", ",").alias("rules"))


@query("expansion_units")
def expansion_units(spark, sf):
    return technical_lines(spark, sf).select(
        "video_id", "seg_idx", translation.expansion_units(F.col("text"), GLOSSARY).alias("units")
    )


def _report(df):
    n = "normalization"
    return df.select(
        "video_id",
        "seg_idx",
        "text_vi",
        "text_tts",
        F.array_join(f"{n}.applied_rules", ",").alias("rules"),
        *[F.col(f"{n}.{c}").alias(c) for c in (
            "written_units", "spoken_units", "budget", "normalization_expansion", "duration", "density", "max_units"
        )],
        F.array_join(f"{n}.warnings", "; ").alias("warnings"),
    )


@query("normalize_segments")
def normalize_segments(spark, sf):
    rows = technical_lines(spark, sf).select(
        "video_id", "seg_idx", F.col("text").alias("text_vi"), (F.length("text") % 40).alias("budget")
    )
    return _report(translation.normalize_segments(rows, GLOSSARY))


@query("renormalize")
def renormalize(spark, sf):
    rows = technical_lines(spark, sf)
    translated = rows.select(
        "video_id",
        "seg_idx",
        F.col("text").alias("text_vi"),
        F.when(F.col("seg_idx") % 3 == 0, F.create_map(F.lit("API"), F.lit("a pi ai"))).alias("pronunciation_map"),
    )
    return _report(translation.renormalize(translated, rows.select("video_id", "seg_idx", "duration"), GLOSSARY))


@query(
    "apply_corrections",
    """SELECT video_id, seg_idx, CASE WHEN length(text) % 7 = 0 THEN 'sửa đoạn này' ELSE text_vi END AS text_vi,
         CASE WHEN length(text) % 7 = 0 THEN 'sửa đoạn này' ELSE text_tts END AS text_tts, length(text) % 7 = 0 AS corrected FROM v_segments""",
)
def apply_corrections(spark, sf):
    rows = views.segments(spark, sf)
    wanted = rows.where(F.length("text") % 7 == 0).select("video_id", "seg_idx", F.lit(" sửa  đoạn này ").alias("text_vi"))
    return translation.apply_corrections(rows, wanted, GLOSSARY).select(
        "video_id", "seg_idx", "text_vi", "text_tts", "corrected"
    )


# ---- batches and prompts -----------------------------------------------------------------------
def _plain_bodies(spark, sf):
    return line_segments(spark, sf).select("video_id", "seg_idx", F.col("text").alias("body"))


@query("translation_batches")
def translation_batches(spark, sf):
    """Batches with budget labels and both limits, over all lines."""
    bodies = translation.line_bodies(technical_lines(spark, sf), GLOSSARY)
    return translation.translation_batches(translation.batch_lines(bodies, fv.API_BATCH_SIZE, fv.API_MAX_CHARS))


@query(
    "translation_batches_by_chars",
    """SELECT video_id, seg_idx, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS batch_no, k AS line_no
       FROM v_filled""",
)
def translation_batches_by_chars(spark, sf):
    lines = translation.batch_lines(_plain_bodies(spark, sf), 8, 400)
    return lines.select("video_id", "seg_idx", "batch_no", "line_no")


SQL_VIEWS["v_filled"] = """
  SELECT video_id, line_idx AS seg_idx, 1::BIGINT AS k, length(line) + 4 AS total FROM v_lines WHERE line_idx = 0
  UNION ALL
  SELECT l.video_id, l.line_idx, CASE WHEN f.k < 8 AND f.total + length(line) + 4 <= 400 THEN f.k + 1 ELSE 1 END,
    CASE WHEN f.k < 8 AND f.total + length(line) + 4 <= 400 THEN f.total + length(line) + 4 ELSE length(line) + 4 END
  FROM v_filled f JOIN v_lines l ON l.video_id = f.video_id AND l.line_idx = f.seg_idx + 1
"""
SQL_VIEWS["v_batches"] = """
  SELECT video_id, line_idx // 5 + 1 AS batch_no, '[batch_' || (line_idx // 5 + 1) || ']' || chr(10) || chr(10)
      || string_agg((line_idx % 5 + 1) || '. ' || line, chr(10) ORDER BY line_idx) AS data FROM v_lines GROUP BY video_id, line_idx // 5
"""


def _small_batches(spark, sf):
    return translation.translation_batches(translation.batch_lines(_plain_bodies(spark, sf), 5))


@query("translation_batches_by_count", "SELECT * FROM v_batches")
def translation_batches_by_count(spark, sf):
    return _small_batches(spark, sf).select("video_id", "batch_no", "data")


_TEMPLATE = "Title: {title}\nChannel: {channel}\nHeader: {header}\n{data}"


@query(
    "render_prompts",
    """SELECT b.video_id, batch_no, 'Title: ' || coalesce(title, '') || chr(10) || 'Channel: ' || coalesce(channel, '') || chr(10)
         || 'Header: [batch_' || batch_no || ']' || chr(10) || data AS prompt
       FROM v_batches b LEFT JOIN (SELECT replace(video_id, 'v', 'd') AS video_id, title, channel FROM v_meta) m ON m.video_id = b.video_id""",
)
def render_prompts(spark, sf):
    cards = views.metadata(spark, sf).withColumn("video_id", F.replace("video_id", F.lit("v"), F.lit("d")))
    return translation.render_prompts(_small_batches(spark, sf), cards, _TEMPLATE)


@query(
    "render_chapter_prompts",
    """SELECT video_id, 0::BIGINT AS part, 'Title: ' || trim(coalesce(title, '')) || chr(10) || data AS prompt FROM (
         SELECT video_id, string_agg("index" || '. ' || trim(title), chr(10) ORDER BY "index") AS data FROM v_chapters GROUP BY video_id)
       JOIN (SELECT video_id, title FROM v_meta) USING (video_id)""",
)
def render_chapter_prompts(spark, sf):
    found = chapters.normalize_chapters(views.raw_chapters(spark, sf))
    return translation.render_chapter_prompts(found, views.metadata(spark, sf), "Title: {title}\n{data}")


# ---- answers ---------------------------------------------------------------------------------
_LINE = "^\\s*(\\d+)\\s*[.):\\-]\\s*(.*)$"
SQL_VIEWS["v_answer_lines"] = f"""
  SELECT *, regexp_extract(l, '{_LINE}', 1)::BIGINT AS number, {sb.strip(f"regexp_extract(l, '{_LINE}', 2)")} AS line_text,
         row_number() OVER (PARTITION BY doc_id ORDER BY li) - 1 AS line_no
  FROM (SELECT video_id, doc_id, prompt_index, expected, nullif(regexp_extract(response, '\\[(.*?)\\]', 1), '') AS batch_name, unnest(ls) AS l, unnest(range(len(ls))) AS li
        FROM (SELECT *, string_split({sb.strip('response')}, chr(10)) AS ls FROM v_responses))
  WHERE regexp_matches(l, '{_LINE}')
"""


@query("parse_responses", "SELECT video_id, batch_name, line_no, number, line_text FROM v_answer_lines")
def parse_responses(spark, sf):
    return validation.parse_responses(views.responses(spark, sf)).select(
        "video_id", "batch_name", "line_no", "number", "line_text"
    )


SQL_VIEWS["v_checked"] = f"""
  SELECT r.video_id, r.doc_id, r.expected, coalesce(n, 0) AS n_lines, CASE
    WHEN {sb.strip('response')} = '' THEN 'blank_response'
    WHEN regexp_extract(response, '(\\[.*?\\])', 1) = '' THEN 'no_batch'
    WHEN name <> 'batch_' || (prompt_index + 1) AND NOT starts_with(name, 'batch_' || (prompt_index + 1) || '_r') THEN 'wrong_batch:' || name
    WHEN n IS NULL THEN 'no_lines' WHEN err IS NOT NULL THEN err WHEN expected > 0 AND n <> expected THEN 'line_count:' || n || ':' || expected END AS error
  FROM (SELECT *, regexp_extract(response, '\\[(.*?)\\]', 1) AS name FROM v_responses) r
  LEFT JOIN (SELECT doc_id, count(*) AS n, arg_min(e, line_no) FILTER (e IS NOT NULL) AS err FROM (
      SELECT *, CASE WHEN line_text = '' THEN 'empty_line:' || number WHEN number <> line_no + 1 THEN 'misplaced_line:' || number || ':' || (line_no + 1) END AS e
      FROM v_answer_lines) GROUP BY doc_id) l USING (doc_id)
"""


@query("validate_responses", "SELECT video_id, n_lines, error FROM v_checked")
def validate_responses(spark, sf):
    return validation.validate_responses(views.responses(spark, sf)).select("video_id", "n_lines", "error")


@query(
    "retry_decision",
    "SELECT video_id, coalesce(starts_with(error, 'line_count') AND expected > 5, false) AS retry FROM v_checked",
)
def retry_decision(spark, sf):
    """Batches worth halving: a wrong line count and enough lines."""
    checked = validation.validate_responses(views.responses(spark, sf))
    retry = validation.is_line_count_error(F.col("error")) & (F.col("expected") > fv.RETRY_MIN_LINES)
    return checked.select("video_id", retry.alias("retry"))


SQL_VIEWS["v_line_errors"] = """
  SELECT video_id AS batch_key, line_no, CASE WHEN length(line_text) > 200 THEN 'too_long' ELSE 'no_stop' END AS error FROM v_answer_lines
  WHERE length(line_text) > 200 OR right(line_text, 1) <> '.'
"""


def _rollup(spark, sf):
    answers = views.responses(spark, sf)
    checked = validation.validate_responses(answers).select(F.col("video_id").alias("batch_key"), "doc_id", "error")
    text = F.col("line_text")
    errors = (
        validation.parse_responses(answers)
        .where((F.length(text) > 200) | (F.substring(text, -1, 1) != "."))
        .select(
            F.col("video_id").alias("batch_key"),
            "line_no",
            F.when(F.length(text) > 200, "too_long").otherwise("no_stop").alias("error"),
        )
    )
    return validation.validation_rollup(checked, errors)


SQL_VIEWS["v_rollup"] = """
  SELECT c.video_id AS batch_key, c.doc_id, coalesce(n, 0) AS n_errors, c.error IS NULL AND coalesce(n, 0) = 0 AS ok,
    coalesce(c.error, d || CASE WHEN n > 5 THEN '; and ' || (n - 5) || ' more' ELSE '' END, '') AS detail
  FROM v_checked c LEFT JOIN (
    SELECT batch_key, count(*) AS n, string_agg('line ' || line_no || ': ' || error, '; ' ORDER BY line_no) FILTER (r <= 5) AS d
    FROM (SELECT *, row_number() OVER (PARTITION BY batch_key ORDER BY line_no) AS r FROM v_line_errors) GROUP BY batch_key) e
  ON e.batch_key = c.video_id
"""


@query("validation_rollup", "SELECT batch_key, n_errors, ok, detail FROM v_rollup")
def validation_rollup(spark, sf):
    return _rollup(spark, sf).drop("doc_id")


@query(
    "batch_progress",
    """SELECT doc_id % 10 AS project, count(*) AS batches, count(*) FILTER (ok) AS validated, count(*) FILTER (NOT ok) AS failed,
         sum(n_errors)::BIGINT AS errors FROM v_rollup GROUP BY 1""",
)
def batch_progress(spark, sf):
    return validation.batch_progress(_rollup(spark, sf).withColumn("project", F.col("doc_id") % 10), "project")


SQL_VIEWS["v_chapter_answers"] = """
  SELECT video_id, n, CASE h WHEN 4 THEN '[chapter]' ELSE '[chapters]' END || chr(10) || body AS response, h FROM (
    SELECT video_id, count(*) AS n, count(*) % 6 AS h, string_agg(CASE WHEN "index" = 2 AND k % 5 = 1 THEN 9 ELSE "index" END || CASE WHEN "index" = 3 AND k % 5 = 2 THEN ') ' ELSE '. ' END || ' vi  ' || title, chr(10) ORDER BY "index")
       FILTER (NOT ("index" = 1 AND k % 5 = 3)) AS body
    FROM (SELECT *, length(max(title) OVER (PARTITION BY video_id)) + count(*) OVER (PARTITION BY video_id) AS k FROM v_chapters) GROUP BY video_id)
"""


@query(
    "validate_chapter_titles",
    f"""SELECT video_id, CASE WHEN ls[1] <> '[chapters]' THEN 'bad_header' WHEN len(ls) - 1 <> n THEN 'line_count:' || (len(ls) - 1) || ':' || n ELSE bad END AS error,
         CASE WHEN ls[1] = '[chapters]' AND len(ls) - 1 = n AND bad IS NULL THEN titles ELSE '' END AS titles FROM (
       SELECT a.*, (SELECT min(CASE WHEN NOT regexp_matches(l, '^(\\d+)\\.\\s+(.+?)\\s*$') THEN 'bad_form:' || (li + 1)
                      WHEN regexp_extract(l, '^(\\d+)\\.', 1)::BIGINT <> li + 1 THEN 'misplaced_line:' || (li + 1) END)
                    FROM (SELECT unnest(ls[2:]) AS l, unnest(range(len(ls) - 1)) AS li)) AS bad,
         (SELECT string_agg({sb.squeeze("regexp_extract(l, '^(\\d+)\\.\\s+(.+?)\\s*$', 2)")}, '|' ORDER BY li) FROM (SELECT unnest(ls[2:]) AS l, unnest(range(len(ls) - 1)) AS li)) AS titles
       FROM (SELECT *, list_filter(list_transform(string_split(response, chr(10)), lambda x: {sb.strip('x')}), lambda x: x <> '') AS ls FROM v_chapter_answers) a)""",
)
def validate_chapter_titles(spark, sf):
    found = chapters.normalize_chapters(views.raw_chapters(spark, sf))
    per_video = found.groupBy("video_id").agg(F.count("*").alias("n"), F.max("title").alias("t")).withColumn(
        "k", F.length("t") + F.col("n")
    )
    rows = found.join(per_video, "video_id")
    index, k = F.col("index"), F.col("k")
    line = F.concat(
        F.when((index == 2) & (k % 5 == 1), 9).otherwise(index),
        F.when((index == 3) & (k % 5 == 2), ") ").otherwise(". "),
        F.lit(" vi  "),
        F.col("title"),
    )
    kept = rows.where(~((index == 1) & (k % 5 == 3))).withColumn("line", line)
    body = kept.groupBy("video_id", "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    head = F.when(F.col("n") % 6 == 4, "[chapter]").otherwise(fv.CHAPTER_HEADER)
    answers = body.select("video_id", F.col("n").alias("n_chapters"), F.concat(head, F.lit("\n"), F.col("body")).alias("response"))
    return validation.validate_chapter_titles(answers).select(
        "video_id", "error", F.array_join("titles", "|").alias("titles")
    )


# ---- attaching -------------------------------------------------------------------------------
@query(
    "attach_translations",
    """SELECT s.video_id, s.seg_idx, CASE WHEN ok AND seg_idx % 2 = 0 THEN 'mới ' || seg_idx ELSE text_vi END AS text_vi,
         CASE WHEN ok THEN 'đọc ' || seg_idx ELSE text_tts END AS text_tts, CASE WHEN NOT ok THEN 'line_count:' || have || ':' || need END AS error
       FROM v_segments s JOIN (SELECT video_id, count(*) AS need, count(*) FILTER (NOT (conv_id % 3 = 1 AND seg_idx = 1)) AS have,
           count(*) = count(*) FILTER (NOT (conv_id % 3 = 1 AND seg_idx = 1)) AS ok FROM v_segments GROUP BY video_id) c USING (video_id)""",
)
def attach_translations(spark, sf):
    rows = views.timed_segments(spark, sf)
    lines = rows.where(~((F.col("conv_id") % 3 == 1) & (F.col("seg_idx") == 1))).select(
        "video_id",
        "seg_idx",
        F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit("mới "), F.col("seg_idx"))).alias("vi"),
        F.concat(F.lit("đọc "), F.col("seg_idx")).alias("tts"),
    )
    return translation.attach_translations(rows, lines).select("video_id", "seg_idx", "text_vi", "text_tts", "error")


@query(
    "attach_chapter_titles",
    """SELECT c.video_id, chapter_idx, CASE WHEN error IS NULL THEN 'vi ' || title END AS title_vi, error FROM (SELECT *, "index" AS chapter_idx FROM v_chapters) c JOIN (
         SELECT video_id, CASE WHEN count(*) FILTER (NOT (n % 4 = 1 AND "index" = 1)) <> count(*) THEN 'title_count'
            WHEN bool_or(length(title) % 11 = 0) THEN 'blank_title' END AS error
         FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_chapters) GROUP BY video_id) e USING (video_id)""",
)
def attach_chapter_titles(spark, sf):
    found = chapters.normalize_chapters(views.raw_chapters(spark, sf)).withColumnRenamed("index", "chapter_idx")
    counted = found.join(found.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    titles = counted.where(~((F.col("n") % 4 == 1) & (F.col("chapter_idx") == 1))).select(
        "video_id",
        "chapter_idx",
        F.when(F.length("title") % 11 == 0, "  ").otherwise(F.concat(F.lit("vi  "), F.col("title"))).alias("title_vi"),
    )
    return catalogue.attach_chapter_titles(found, titles).select("video_id", "chapter_idx", "title_vi", "error")


# ---- retries ---------------------------------------------------------------------------------
_ROUND = """SELECT batch_key, doc_line, line, CASE WHEN n > 5 THEN path || '_r{d}_' || CASE WHEN line_no > h THEN 2 ELSE 1 END ELSE path END AS path,
    CASE WHEN n > 5 AND line_no > h THEN line_no - h ELSE line_no END AS line_no, CASE WHEN n > 5 THEN CASE WHEN line_no > h THEN n - h ELSE h END ELSE n END AS n
  FROM (SELECT *, (n + 1) // 2 AS h FROM ({src}))"""
SQL_VIEWS["v_retry"] = _ROUND.format(
    d=3,
    src=_ROUND.format(
        d=2,
        src=_ROUND.format(
            d=1,
            src="SELECT video_id AS batch_key, line_idx AS doc_line, line, 'batch_1' AS path, line_idx + 1 AS line_no, count(*) OVER (PARTITION BY video_id) AS n FROM v_lines",
        ),
    ),
)


def _retried(spark, sf):
    lines = views.lines(spark, sf)
    sizes = lines.groupBy("video_id").agg(F.count("*").alias("n_lines"))
    rows = lines.join(sizes, "video_id").select(
        F.col("video_id").alias("batch_key"),
        F.col("line_idx").alias("doc_line"),
        "line",
        F.lit("batch_1").alias("path"),
        F.lit(0).alias("depth"),
        (F.col("line_idx") + 1).alias("line_no"),
        "n_lines",
    )
    for _ in range(fv.RETRY_MAX_DEPTH):
        rows = translation.retry_split(rows)
    return rows


@query("retry_split", "SELECT batch_key, doc_line, path, line_no, n AS n_lines FROM v_retry")
def retry_split(spark, sf):
    return _retried(spark, sf).select("batch_key", "doc_line", "path", "line_no", "n_lines")


@query("retry_merge", "SELECT batch_key, doc_line + 1 AS merged_no, line FROM v_retry")
def retry_merge(spark, sf):
    return translation.retry_merge(_retried(spark, sf)).select("batch_key", "merged_no", "line")
