"""Text, number and density columns: pinned values and plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.functions import numbers as num
from cuewright.functions import spoken
from cuewright.functions import text as txt
from cuewright.operators import chapters, chunking, translation, validation


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_spoken_units(spark):
    values = ["container", "machine", "Xin chào các bạn", "rhythm-bcd 42 _ x1", "", "été naïve", None]

    def plain(text):
        tokens = re.findall(r"[\wÀ-ỹ]+", (text or "").replace("-", " "))
        return sum(1 if re.search("[À-ỹ]", t) else max(1, len(re.findall("[aeiouyAEIOUY]+", t))) for t in tokens)

    got = column(spark, values, txt.spoken_units)
    assert got[:3] == [3, 3, 4]
    assert got == [plain(v) for v in values]


def test_density_pinned(spark):
    rows = spark.createDataFrame([(15, 18), (15, 11)], "t long, b long")
    a, b = [r.d for r in rows.select(num.density(F.col("t"), F.lit(None).cast("double"), F.col("b")).alias("d")).collect()]
    assert (a.min_units, a.target_units, a.base_max_units, a.tolerance_units, a.max_units, len(a.warnings)) == (9, 14, 15, 6, 21, 0)
    assert b.max_units == 13 and len(b.warnings) == 1


def test_budget_label_pinned(spark):
    budgets = spark.createDataFrame([(24 - 3,), (24,)], "b long")
    assert [r.l for r in budgets.select(num.budget_label(F.col("b")).alias("l")).collect()] == ["[11-26 tiếng]", "[12-28 tiếng]"]


def test_numbers_pinned(spark):
    pairs = {1250: "một nghìn hai trăm năm mươi", 305: "ba trăm lẻ năm", 21: "hai mươi mốt", 24: "hai mươi tư", 15: "mười lăm",
             2024: "hai nghìn không trăm hai mươi tư", 1005: "một nghìn không trăm lẻ năm", -5: "âm năm", 0: "không", 11: "mười một"}
    assert dict(zip(pairs, column(spark, list(pairs), spoken.spell_number, "long"))) == pairs
    assert column(spark, ["3.14", "1,250", "0007", "1.2.3"], spoken.amount_words) == [
        "ba phẩy một bốn", "một nghìn hai trăm năm mươi", "bảy", "một phẩy hai ba",
    ]
    assert column(spark, ["1000000000000000000000"], spoken.integer_words) == ["một"]


def test_cascade_pinned(spark):
    values = ["GPT-4 hỗ trợ CLI và API.", "Mô hình LLM cần 16 GB.", "docker ps -a", "/app/src/main.py", "node:22-alpine", "f(x) = 3.14 + y", "RAM 20% $5", "nam/nữ 1,250"]
    got = column(spark, values, lambda c: spoken.normalize_text(c, fv.BUILTIN_GLOSSARY)["text"])
    assert got == [
        "ji pi ti bốn hỗ trợ si eo ai và ei pi ai.",
        "Mô hình eo eo em cần mười sáu gi ga bai.",
        "docker ps trừ ei",
        "siệt app siệt src siệt main chấm py",
        "node hai mươi hai alpine",
        "ép của ích bằng ba phẩy một bốn cộng y",
        "ram hai mươi phần trăm năm đô",
        "nam/nữ một nghìn hai trăm năm mươi",
    ]
    rules = column(spark, ["RAM 16 GB"], lambda c: spoken.normalize_text(c, fv.BUILTIN_GLOSSARY)["rules"])
    assert rules == [["glossary", "measurement"]]


def test_expansion_pinned(spark):
    assert column(spark, ["The LLM needs 16 GB"], lambda c: translation.expansion_units(c)) == [5]


def test_canonical(spark):
    values = ["Xin  chào\n thế giới .", "'AI' don't “x”", None, "e\u0301 \u00a0 a"]
    assert column(spark, values, spoken.canonicalize_text) == ["Xin chào thế giới.", "AI don't x", "", "é a"]


def test_more_spoken_forms(spark):
    pairs = {
        "--max-len 5": "trừ trừ max-len năm",
        "a = b - c": "a bằng b trừ c",
        "x_1 and X_12": "x_1 and ích một hai",
        "H-264 or H264": "hát hai sáu bốn or hát hai sáu bốn",
        "example.com/path": "example chấm com siệt path",
        "2.5GHz 100 ms": "hai phẩy năm gi ga héc một trăm mi li giây",
        "": "",
    }
    assert column(spark, list(pairs), lambda c: spoken.normalize_text(c)["text"]) == list(pairs.values())
    rules = column(spark, ["RAM x 5% --a GPU $3 None"], lambda c: spoken.normalize_text(c, fv.BUILTIN_GLOSSARY)["rules"])
    assert rules == [["acronym", "cli_flag", "currency", "glossary", "math_variable", "percentage"]]


@pytest.mark.parametrize("words_only", [False, True])
def test_pronounce_matches_python(spark, words_only):
    mapping = {"RAG": "rác", "RAG flow": "$1 \\x", "c++": "xê cộng", " ": "bad", "é": "e", "a\\Eb": "quoted"}
    values = ["RAG dùng RAGFlow rag", "use RAG flow, C++ and c++x", "é été É", "x a\\Eb y"]
    literal = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    got = column(spark, values, lambda c: spoken.pronounce(c, literal, words_only))
    clean = spoken.clean_map(mapping)
    order = clean if words_only else sorted(clean, key=len, reverse=True)

    def plain(text):
        for k in order:
            before = r"(?<!\w)" if words_only or re.match(r"\w", k[0]) else ""
            after = r"(?!\w)" if words_only or re.match(r"\w", k[-1]) else ""
            text = re.sub(before + re.escape(k) + after, lambda m, k=k: clean[k], text, flags=re.I)
        return text

    assert got == [plain(v) for v in values]


def test_row_map_wins(spark):
    rows = spark.createDataFrame([("v", 0, "Kircer ở đây", {"Kircer": "kơ sờ"})], "video_id string, seg_idx long, text_vi string, pronunciation_map map<string,string>")
    row = translation.normalize_segments(rows).first()
    assert (row.text_vi, row.text_tts) == ("Kircer ở đây", "kơ sờ ở đây")
    assert row.normalization.applied_rules[0] == "pronunciation_map"


def test_tier_lookup_pinned(spark):
    got = column(spark, [None, 1.9, 2.0, 3.4, 3.5, 24.0], lambda c: num.tier_of(c, {2.0: "a", 3.5: "b"}), "double")
    assert got == [None, None, "a", "a", "b", "b"]


def test_text_chunks_cover_and_overlap():
    words = [f"w{i}" + ("." if i % 7 == 0 else "") + ("\n" if i % 50 == 0 else " ") for i in range(900)]
    text = "".join(words) + "\n\n" + "".join(str(i) for i in range(500))
    chunks = chunking.split_text(text, 500, 100)
    assert all(0 < len(c) <= 500 for c in chunks)
    squeezed = re.sub(r"\s+", "", text)
    at = 0
    for c in chunks:
        flat = re.sub(r"\s+", "", c)
        found = squeezed.find(flat)
        assert 0 <= found <= at
        at = found + len(flat)
    assert at == len(squeezed)


def test_chapters_pinned(spark):
    raw = spark.createDataFrame(
        [("a", 0, 0.0, 28.0, "One", 90.0), ("a", 1, 30.0, None, "Two", 90.0), ("b", 0, 0.0, 5.0, "Only", 9.0)],
        "video_id string, pos long, start double, end double, title string, duration double",
    )
    text = "00:00 Intro\n01:05 - Next\n02:30 | Last"
    told = spark.createDataFrame([("c", 180.0, text), ("d", 180.0, "00:05 late\n01:00 x")], "video_id string, duration double, description string")
    got = [(r["video_id"], r["index"], r["start"], r["end"], r["source"]) for r in chapters.chapters(raw, told).orderBy("video_id", "index").collect()]
    assert got == [
        ("a", 1, 0.0, 30.0, "yt-dlp"), ("a", 2, 30.0, 90.0, "yt-dlp"),
        ("c", 1, 0.0, 65.0, "description"), ("c", 2, 65.0, 150.0, "description"), ("c", 3, 150.0, 180.0, "description"),
    ]


def test_chapter_answers_pinned(spark):
    answers = ["[chapters]\n1. Một\n2. Hai", "[chapters]\n1. Một", "[chapters]\n2. Hai\n1. Một", "[x]\n1. a\n2. b"]
    rows = spark.createDataFrame([(str(i), a, 2) for i, a in enumerate(answers)], "video_id string, response string, n_chapters long")
    got = [r.error for r in validation.validate_chapter_titles(rows).orderBy("video_id").collect()]
    assert got == [None, "line_count:1:2", "misplaced_line:1", "bad_header"]


def test_fit_report_pinned(spark):
    rows = spark.createDataFrame([(800, 300, 0)], "raw long, slot long, rest long")
    report = rows.select(num.fit_report(F.col("raw"), F.col("slot"), F.col("rest"), 1000).alias("r")).first().r
    assert report.fit_ratio > 1.75 and report.warnings == ["tempo_strong"]


def test_functions_for_sql(spark):
    from cuewright.functions.register import register

    register(spark)
    row = spark.sql("SELECT squeeze_text(' a  b .') AS a, digits_apart('x2-1') AS b").first()
    assert tuple(row) == ("a b.", "hai một")
