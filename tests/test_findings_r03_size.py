"""Steps that cost more than their rows: patterns, words that were shuffled, answers of every shard."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions import spoken
from cuewright.functions import text as txt
from cuewright.operators import chapters, neighbour_graph, postings
from cuewright.session import scratch_path, written_once


def caught(monkeypatch, module):
    """The tables that ``module`` writes, by name."""
    tables = {}

    def keep(df, name):
        tables.setdefault(name, df)
        return written_once(df, name)

    monkeypatch.setattr(module, "written_once", keep)
    return tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_language_by_ranges_of_letters(spark):
    near = {chr(ord(c) + d) for c in fv.VIETNAMESE_LETTERS for d in (-1, 0, 1)}
    rows = spark.createDataFrame([(c, f"ab {c} cd") for c in near], "c string, t string")
    found = rows.select("c", txt.detect_language(F.col("t"), F.lit("src")).alias("lang"))
    assert {r.c for r in found.collect() if r.lang == "vi"} == set(fv.VIETNAMESE_LETTERS)
    assert r"\x{1ea0}-\x{1ef9}" in plan(found)  # before: each letter was a test of its own


def test_squeeze_of_all_whitespace(spark):
    texts = [f"{a}x{b}y {c}" for a in ("", " ", "  ") for b in (" ", "  ", "\n", " \t", "　  ", "​") for c in ("", " ", "\u0085")]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", txt.squeeze(F.col("t")).alias("s")).collect()
    assert all(r.s == re.sub(f"[{fv.WHITESPACE}]+", " ", r.t).strip(" ") for r in found)


def test_stamped_lines_are_matched_once(spark, monkeypatch):
    tables = caught(monkeypatch, chapters)
    lines = ["00:00 a", " 0:05 -  b  c ", "00:07 - ", "1:02:03|d", "00:09\u0085 e", "00:10 f\u0085", "00:11 g\u0085h", "x 00:12 i", "00:13j", "00:14 k\0l", "00:15\0m", "00:75 n", "00:16 "]
    rows = spark.createDataFrame([("d", 9e9, "\n".join(lines))], "video_id string, duration double, description string")
    got = chapters.description_chapters(rows)
    stamped = tables["described"]
    assert "regexp_extract" not in plan(stamped)  # before: three matches of the whole pattern for a line
    old = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos long, line string").where(F.col("line").rlike(chapters.STAMPED_LINE))
    old = old.select("pos", chapters.timestamp_seconds(F.regexp_extract("line", chapters.STAMPED_LINE, 1)).alias("start"), txt.squeeze(F.regexp_extract("line", chapters.STAMPED_LINE, 2)).alias("title"))
    kept = "start is not null and title <> ''"
    assert sorted(map(tuple, stamped.where(kept).select("pos", "start", "title").collect())) == sorted(map(tuple, old.where(kept).collect()))
    assert got.count() >= 2


def test_canonical_text_and_one_lower_case(spark):
    words = ["é", "Tiếng", "'a'", "it's", "x'", "“q”", "a\0b", "ấ", "한하", "̈́", " ,", "  ", "!", "`", "\U00010400'"]
    texts = [f"{a} {b}{c}" for a in words for b in words for c in words[:4]] + [None, ""]
    double, single = fv.QUOTES_TO_DOUBLE + '"', fv.QUOTES_TO_SINGLE

    def plain(t):
        t = unicodedata.normalize("NFC", t or "")
        t = t.translate({**{ord(c): " " for c in double + "\0"}, **{ord(c): "'" for c in single}})
        word = lambda c: c == "_" or (unicodedata.category(c)[0] in "LN" and ord(c) < 0x10000)
        t = "".join(" " if c == "'" and not (i and word(t[i - 1]) and i + 1 < len(t) and (word(t[i + 1]) or t[i + 1] == "\U00010400")) else c for i, c in enumerate(t))
        return re.sub(r" ([,.;:!?])", r"\1", re.sub(f"[{fv.WHITESPACE}]+", " ", t).strip(" "))

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [(r.t, r.s, plain(r.t)) for r in rows.select("t", spoken.canonicalize_text(F.col("t")).alias("s")).collect() if r.s != plain(r.t)]
    assert not wrong, wrong[:5]
    glossary = {w: "x" for w in ("one", "two", "three", "four", "five")}
    said = rows.select(spoken.normalize_text(F.col("t"), glossary)["text"].alias("s"))
    assert len(re.findall(r"contains\(lower\(", said._jdf.queryExecution().optimizedPlan().toString())) == 0  # before: one for each word


def test_postings_are_listed_without_shuffling_words(spark, monkeypatch):
    tables = caught(monkeypatch, postings)
    rng = np.random.default_rng(3)
    rows = [(f"v{c % 3}", c, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 9))))) for c in range(300)] + [("v1", 7, "a a b"), (None, 1, "a")]
    postings.write_postings(spark.createDataFrame(rows, "video_id string, chunk_id long, text string"), scratch_path(spark, "p"))
    listed = tables["index-blocks"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video_id" in listed and not re.search(r"hashpartitioning\([^)]*term", listed)  # before: every word went by its term


def test_a_query_has_one_answer_from_a_tile_of_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "SHARD_ROWS", 16)
    monkeypatch.setattr(neighbour_graph, "TILE_SHARDS", 4, raising=False)
    monkeypatch.setattr(neighbour_graph, "QUERY_ROWS", 50, raising=False)
    tables = caught(monkeypatch, neighbour_graph)
    x = np.random.default_rng(5).normal(size=(200, 6))
    rows = spark.createDataFrame([("a" if i % 10 else "b", i, v.tolist()) for i, v in enumerate(x)], "video_id string, chunk_id long, vec array<double>")
    path = scratch_path(spark, "g")
    neighbour_graph.build(rows, path)
    found, counts = neighbour_graph.search(spark, path, rows.withColumnRenamed("chunk_id", "query_id"), 5)
    assert tables["graph-found"].count() == 180 * 3 + 20  # 12 shards in three tiles, 2 in one; before: a row for every chunk found in a shard
    assert counts.count() == 180 * 12 + 20 * 2
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for r in found.collect():
        own = [j for j in range(200) if (j % 10 == 0) == (r.query_id % 10 == 0)]
        hits += r.chunk_id in sorted(own, key=lambda j: -unit[r.query_id] @ unit[j])[:5]
    assert found.count() == 1000 and hits >= 950
