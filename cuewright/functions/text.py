"""Text columns built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright import fixed_values as fv



def char_class(chars: str) -> str:
    """The inside of a character class: what lies beyond Latin-1 as ranges. A class that lists many such characters is tested one by one."""
    ranges: list[list[int]] = []
    for c in sorted({ord(c) for c in chars if ord(c) > 255}):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars if ord(c) < 256) + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


SPACES = char_class(fv.WHITESPACE)
#: Whitespace but the blank; and a run of whitespace other than one blank.
OTHER_SPACES = char_class(fv.WHITESPACE.replace(" ", ""))
_SPACE_RUN = f"[{OTHER_SPACES}][{SPACES}]*| [{SPACES}]+"
_VIETNAMESE = "[" + char_class(fv.VIETNAMESE_LETTERS) + "]"
_VIDEO_URL = (
    r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/|youtube\.com/embed/|youtube\.com/live/)"
    r"([A-Za-z0-9_-]{11})"
)


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends (Spark's ``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def squeeze(text: Column) -> Column:
    """Whitespace runs become one blank; ends are stripped."""
    return F.btrim(F.regexp_replace(text, _SPACE_RUN, " "))


def one_line(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def filled(text: Column) -> Column:
    """Null when the text is null or empty; whitespace counts as content."""
    return F.when(text != "", text)


def segment_text(text_vi: Column, text_tts: Column, text: Column) -> Column:
    """Text used for retrieval: translation, else speech text, else the source line."""
    return F.coalesce(
        F.when(text_vi != "", strip(text_vi)),
        F.when(text_tts != "", strip(text_tts)),
        one_line(F.coalesce(text, F.lit(""))),
    )


def display_text(text_vi: Column, text_tts: Column, text: Column, lang: str) -> Column:
    """Text shown for a language: ``en`` source, ``vi`` translation with the speech text behind it."""
    if lang == "en":
        return one_line(F.coalesce(text, F.lit("")))
    if lang != "vi":
        raise ValueError(f"unknown language {lang!r}")
    return F.coalesce(F.when(text_vi != "", strip(text_vi)), strip(F.coalesce(text_tts, F.lit(""))))


def reference_text(text: Column, text_tts: Column, text_vi: Column, source_texts: Column) -> Column:
    """Text of the source audio, with the translated fields as fallback."""
    joined = F.array_join(F.filter(source_texts, lambda x: x != ""), " ")
    return strip(F.coalesce(filled(text), filled(text_tts), filled(text_vi), joined, F.lit("")))


def fmt_time(seconds: Column) -> Column:
    """``MM:SS``; minutes may exceed 59."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def cue_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    hours = F.floor(seconds / 3600).cast("long")
    minutes = F.floor((seconds % 3600) / 60).cast("long")
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, seconds % 60)


def video_id(url_or_id: Column) -> Column:
    """The 11-character id from a bare id or one of five URL shapes; null when there is none."""
    s = strip(url_or_id)
    return F.when(s.rlike("^[A-Za-z0-9_-]{11}$"), s).otherwise(filled(F.regexp_extract(s, _VIDEO_URL, 1)))


def detect_language(title: Column, channel: Column) -> Column:
    blob = F.concat_ws(" ", title, channel)
    return F.when(blob.rlike(_VIETNAMESE), "vi").otherwise("en")


def spoken_units(text: Column) -> Column:
    """Spoken syllables: one per token with a Vietnamese letter, else its vowel groups, at least one.

    Three counting passes and no per-token array: accented tokens shrink to one vowel, then vowel
    groups and vowel-free tokens are counted.
    """
    apart = F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(" "))
    # A token is tried at its start only, and a text without accents not at all.
    accented = F.when(
        apart.rlike("[À-ỹ]"), F.regexp_replace(apart, r"(?U)(?<![\wÀ-ỹ])[\w&&[^À-ỹ]]*+[À-ỹ][\wÀ-ỹ]*+", "a")
    ).otherwise(apart)
    vowel_groups = F.regexp_count(accented, F.lit("[aeiouyAEIOUY]+"))
    without_vowel = F.regexp_count(accented, F.lit(r"(?U)(?<!\w)[\w&&[^aeiouyAEIOUY]]++(?!\w)"))
    return (vowel_groups + without_vowel).cast("long")


def clean_summary(text: Column) -> Column:
    """Plain-text summary: no bold, no headings, bullets as ``- ``, at most one blank line."""
    s = strip(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, r"\*\*(.*?)\*\*", "$1")
    s = F.regexp_replace(s, r"(?m)^#{1,6}\s*", "")
    s = F.regexp_replace(s, r"(?m)^\s*[*•]\s+", "- ")
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def clean_answer(text: Column) -> Column:
    """As ``clean_summary`` without the bullet rule, and also strips ``__`` and ``\\( \\)``."""
    s = strip(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, r"\*\*(.*?)\*\*", "$1")
    s = F.regexp_replace(s, r"__(.*?)__", "$1")
    s = F.regexp_replace(s, r"\\\((.*?)\\\)", "$1")
    s = F.regexp_replace(s, r"(?m)^#{1,6}\s*", "")
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def flatten_content(content: Column, drop_blank: bool = True) -> Column:
    """Message content given as a string, or as a JSON list of strings and ``{"text": ...}`` items."""
    items = F.from_json(content, "array<string>")
    texts = F.transform(
        items, lambda i: F.coalesce(F.get_json_object(i, "$.text"), F.when(~i.startswith("{"), i), F.lit(""))
    )
    if drop_blank:
        texts = F.filter(texts, lambda t: t != "")
    joined = F.array_join(texts, "\n")
    is_list = content.startswith("[") & items.isNotNull()
    return strip(F.when(is_list, joined).otherwise(content))


def domain_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.coalesce(filled(host), url)


def stage_progress(stage: Column) -> Column:
    """Load progress in percent from the stage line."""
    percent = F.regexp_extract(stage, r"(\d{1,3})%", 1).try_cast("int")
    return (
        F.when(stage.contains("Whisper STT thành công"), 100)
        .when(
            stage.contains("fallback Whisper")
            | stage.contains("Chuẩn bị Whisper STT")
            | stage.contains("tải model Whisper")
            | stage.contains("chuẩn bị nhận diện giọng nói")
            | stage.contains("progressive"),
            0,
        )
        .when(stage.contains("nhận diện giọng nói"), F.least(F.coalesce(percent, F.lit(0)), F.lit(100)))
        .when(stage.contains("Lấy thông tin video") | stage.contains("Tạo prompts"), 100)
        .otherwise(0)
        .cast("long")
    )


def synthesis_progress(stage: Column) -> Column:
    """``done`` / ``total`` / ``pct`` from a synthesis stage line, null for other lines."""
    pattern = r"Tổng hợp giọng nói (\d+)/(\d+)"
    done = F.regexp_extract(stage, pattern, 1).try_cast("long")
    total = F.greatest(F.regexp_extract(stage, pattern, 2).try_cast("long"), F.lit(1).cast("long"))
    pct = F.least(F.lit(100).cast("long"), F.round(done / total * 100).cast("long"))
    return F.when(
        stage.rlike(pattern), F.struct(done.alias("done"), total.alias("total"), pct.alias("pct"))
    )


def pick_thumbnail(thumbnails: Column) -> Column:
    """First picture with an ``avatar`` id, else the largest square one, else an empty string.

    ``thumbnails`` is ``array<struct<id, url, width, height>>``.
    """
    usable = F.filter(thumbnails, lambda t: t["url"] != "")
    avatars = F.filter(usable, lambda t: F.lower(t["id"]).contains("avatar"))
    squares = F.filter(usable, lambda t: (t["width"] == t["height"]) & (t["width"] > 0))
    widest = F.array_max(F.transform(squares, lambda t: t["width"]))
    first_widest = F.filter(squares, lambda t: t["width"] == widest)
    return F.coalesce(
        F.try_element_at(avatars, F.lit(1))["url"],
        F.try_element_at(first_widest, F.lit(1))["url"],
        F.lit(""),
    )
