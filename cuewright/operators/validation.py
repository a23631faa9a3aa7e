"""Checks over tables of translated responses; errors are codes with their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions.text import squeeze, strip

# Line pattern of a numbered answer: number, one of . ) : -, text.
NUMBERED_LINE = r"^\s*(\d+)\s*[.):\-]\s*(.*)$"
CHAPTER_LINE = r"^(\d+)\.\s+(.+?)\s*$"


def validate_map_rows(rows: DataFrame, position: str) -> DataFrame:
    """Pronunciation rows: both cells or neither; half-filled rows carry an error with their number."""
    source, spoken = strip(F.col("source")), strip(F.col("spoken"))
    full = (source != "") & (spoken != "")
    return rows.where((source != "") | (spoken != "")).withColumns(
        {
            "source": F.when(full, source),
            "spoken": F.when(full, spoken),
            "error": F.when(~full, F.concat(F.lit("incomplete_row:"), F.col(position) + 1)),
        }
    )


def batch_name(response: Column) -> Column:
    """First bracketed name; null when there is none."""
    found = F.regexp_extract(response, r"(\[.*?\])", 1)
    return F.when(found != "", F.substring(found, F.lit(2), F.length(found) - 2))


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per numbered line: ``batch_name, line_no`` (0-based order), ``number, line_text``.

    A response is one value, so its lines are numbered inside the row, without a shuffle.
    """
    lines = F.filter(F.split(strip(F.col("response")), r"\r\n|\n|\r"), lambda x: x.rlike(NUMBERED_LINE))
    return (
        responses.withColumn("batch_name", batch_name(strip(F.col("response"))))
        .select("*", F.posexplode_outer(lines).alias("line_no", "_line"))
        .where(F.col("_line").isNotNull())
        .withColumns(
            {
                "line_no": F.col("line_no").cast("long"),
                "number": F.regexp_extract("_line", NUMBERED_LINE, 1).cast("long"),
                "line_text": strip(F.regexp_extract("_line", NUMBERED_LINE, 2)),
            }
        )
        .drop("_line")
    )


def _first_error(lines: Column) -> Column:
    """First bad line, in order: empty text, then a number out of place."""

    def judge(line, i):
        number = F.regexp_extract(line, NUMBERED_LINE, 1).cast("long")
        empty = strip(F.regexp_extract(line, NUMBERED_LINE, 2)) == ""
        return F.when(empty, F.concat(F.lit("empty_line:"), number)).when(
            number != i + 1, F.concat(F.lit("misplaced_line:"), number, F.lit(":"), i + 1)
        )

    return F.try_element_at(F.array_compact(F.transform(lines, judge)), F.lit(1))


def validate_responses(responses: DataFrame) -> DataFrame:
    """Add ``error`` (first failing check) and ``n_lines``.

    Order: blank answer, no batch name, other batch, no lines, bad line, line count against
    ``expected``. All inside the row.
    """
    response = F.col("response")
    wanted = F.concat(F.lit("batch_"), F.col("prompt_index") + 1)
    lines = F.filter(F.split(strip(response), r"\r\n|\n|\r"), lambda x: x.rlike(NUMBERED_LINE))
    named = responses.withColumns({"_lines": lines, "_name": batch_name(strip(response))})
    size = F.size("_lines").cast("long")
    other = (F.col("_name") != wanted) & ~F.col("_name").startswith(F.concat(wanted, F.lit("_r")))
    error = (
        F.when(strip(response) == "", "blank_response")
        .when(F.col("_name").isNull(), "no_batch")
        .when(other, F.concat(F.lit("wrong_batch:"), F.col("_name")))
        .when(size == 0, "no_lines")
        .otherwise(
            F.coalesce(
                _first_error(F.col("_lines")),
                F.when(
                    (F.col("expected") > 0) & (size != F.col("expected")),
                    F.concat(F.lit("line_count:"), size, F.lit(":"), F.col("expected")),
                ),
            )
        )
    )
    return named.withColumns({"error": error, "n_lines": size}).drop("_lines", "_name")


def is_line_count_error(error: Column) -> Column:
    """Decides whether a failing batch is worth a retry in halves."""
    return F.coalesce(error.startswith("line_count"), F.lit(False))


def validate_chapter_titles(responses: DataFrame) -> DataFrame:
    """Chapter answers (``video_id, response, n_chapters``): exact header, count, form and order."""
    lines = F.filter(
        F.transform(F.split(F.coalesce("response", F.lit("")), r"\r\n|\n|\r"), strip), lambda x: x != ""
    )
    body = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))

    def judge(line, i):
        number = F.regexp_extract(line, CHAPTER_LINE, 1)
        return F.when(~line.rlike(CHAPTER_LINE), F.concat(F.lit("bad_form:"), i + 1)).when(
            number.cast("long") != i + 1, F.concat(F.lit("misplaced_line:"), i + 1)
        )

    listed = responses.withColumn("_lines", lines).withColumn("_body", body)
    error = (
        F.when(F.col("n_chapters") == 0, "no_chapters")
        .when(~F.coalesce(F.try_element_at("_lines", F.lit(1)) == fv.CHAPTER_HEADER, F.lit(False)), "bad_header")
        .when(F.size("_body") != F.col("n_chapters"), F.concat(F.lit("line_count:"), F.size("_body"), F.lit(":"), F.col("n_chapters")))
        .otherwise(F.try_element_at(F.array_compact(F.transform("_body", judge)), F.lit(1)))
    )
    titles = F.transform("_body", lambda x: squeeze(F.regexp_extract(x, CHAPTER_LINE, 2)))
    return listed.withColumn("error", error).withColumn(
        "titles", F.when(F.col("error").isNull(), titles).otherwise(F.array().cast("array<string>"))
    ).drop("_lines", "_body")


def validation_rollup(checked: DataFrame, line_errors: DataFrame) -> DataFrame:
    """Per batch: verdict, number of line errors and the first five in words.

    ``line_errors``: ``batch_key, line_no, error``. Only the five smallest line numbers of a batch
    are gathered, so a batch with very many errors stays small.
    """
    from pyspark.sql import Window

    ranked = line_errors.withColumn(
        "_r", F.row_number().over(Window.partitionBy("batch_key").orderBy("line_no", "error"))
    ).where(F.col("_r") <= 5)
    details = ranked.groupBy("batch_key").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("line_no", "error"))),
                lambda x: F.concat(F.lit("line "), x["line_no"], F.lit(": "), x["error"]),
            ),
            "; ",
        ).alias("first_errors")
    )
    counts = line_errors.groupBy("batch_key").agg(F.count("*").alias("n_errors"))
    n = F.coalesce("n_errors", F.lit(0))
    return (
        checked.join(counts, "batch_key", "left")
        .join(details, "batch_key", "left")
        .withColumns(
            {
                "ok": F.col("error").isNull() & (n == 0),
                "n_errors": n,
                "detail": F.coalesce(
                    F.col("error"),
                    F.concat("first_errors", F.when(n > 5, F.concat(F.lit("; and "), n - 5, F.lit(" more"))).otherwise("")),
                    F.lit(""),
                ),
            }
        )
        .drop("first_errors", "error")
    )


def batch_progress(rollup: DataFrame, key: str = "video_id") -> DataFrame:
    """Validated, failed and error totals per key."""
    return rollup.groupBy(key).agg(
        F.count("*").alias("batches"),
        F.count_if("ok").alias("validated"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum("n_errors").alias("errors"),
    )
