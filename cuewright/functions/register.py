"""Make spoken numbers and canonical text available to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cuewright import fixed_values as fv

_BLANKS = "".join(rf"\\u{ord(c):04x}" for c in fv.WHITESPACE)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions ``digits_apart(text)`` and ``squeeze_text(text)``; both are SQL bodies, no Python runs."""
    names = ", ".join(f"'{name}'" for name in fv.DIGIT_NAMES)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION digits_apart(t STRING) RETURNS STRING RETURN "
        f"array_join(transform(regexp_extract_all(t, '[0-9]', 0), d -> get(array({names}), int(d))), ' ')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION squeeze_text(t STRING) RETURNS STRING RETURN "
        f"regexp_replace(btrim(regexp_replace(t, '[{_BLANKS}]+', ' ')), ' ([,.;:!?])', '$1')"
    )
