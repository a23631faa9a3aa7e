"""Small tables for the operators' edge cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null id, null, empty and blank texts, repeated rows, a long text, line breaks, a null source.
EDGES = [
    (None, "a text without an id", "en", "s1", 20),
    (1, None, "en", "s1", None),
    (2, "", None, "s1", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "same words here and there", "en", "s2", 25),
    (4, "same words here and there", "en", "s2", 25),
    (5, "same words here and there", "de", "s2", 25),
    (6, "Größe über 日本語 😀 ▁ <s> 12 34", "de", None, 30),
    (7, "w " * 30_000, "en", "s3", 60_000),
    (8, "x" * 50_000, "en", "s3", 50_000),
    (9, "one\n\none\r\nTWO \x0bthree", "fr", "s3", 20),
]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def edges(spark):
    return table(spark, EDGES)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def clashing(df, *names):
    """The table with extra columns named like an operator's own helpers."""
    for name in names:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
