"""Document fingerprints: I-Match over randomised sub-lexicons of several densities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import whole_text, with_next, words
from cuewright.session import discard, passing_tables, written_once

#: Share of the lexicon in a sub-lexicon is 2 to the power of minus these; each density is drawn ``DRAWS`` times.
DENSITIES = (4, 6, 8)
DRAWS = 8
KINDS = len(DENSITIES) * DRAWS
#: Inverse-document-frequency band, as the least and most share of documents.
BAND = (0.001, 0.1)
#: A term of as many documents is in the band at any corpus size: the lower end is a share of small tables alone.
FREQUENT = 10
#: Terms that a text has at least, if it has as many (one in a sub-lexicon of the highest density, on average): short of them, its terms nearest to the band are added.
LEAST_TERMS = 16
#: Lexicon entries that may be broadcast: 16 bytes each.
MAX_BROADCAST = 1_000_000
#: Entries that every Python worker may hold instead, 8 bytes each.
MAX_HELD = 32_000_000


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the lower-cased words."""
    return F.array_sort(F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))))


def frequencies(docs: DataFrame, least: int = 1) -> DataFrame:
    """term, count: the terms of at least ``least`` documents, counted over all documents."""
    terms = docs.select(F.explode(term_hashes(whole_text())).alias("term"))
    return terms.groupBy("term").count().where(F.col("count") >= least)


def edges_of(n: int, band: tuple[float, float]) -> tuple[float, float]:
    """The band's ends as numbers of documents."""
    return min(band[0] * n, FREQUENT), band[1] * n


def masked(term: Column) -> Column:
    """The sub-lexicons (bits) a term belongs to."""
    bits = []
    for d, density in enumerate(DENSITIES):
        for draw in range(DRAWS):
            k = d * DRAWS + draw
            drawn = F.pmod(F.xxhash64(F.lit(k), term), F.lit(1 << density)) == 0
            bits.append(F.when(drawn, F.lit(1 << k)).otherwise(F.lit(0)))
    return sum(bits[1:], bits[0]).cast("int")


def in_band(counts: DataFrame, ends: tuple[float, float]) -> DataFrame:
    """term, mask: the counted terms inside the band."""
    return counts.where(F.col("count").between(*ends)).select("term", masked(F.col("term")).alias("mask"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """term, mask: terms whose document frequency lies in the band, and the sub-lexicons (bits) each belongs to."""
    return in_band(frequencies(docs), edges_of(docs.count(), band))


def nearest_terms(texts: DataFrame, counts: DataFrame, ends: tuple[float, float]) -> DataFrame:
    """row, of_edited, term: the ``LEAST_TERMS`` terms of each text that are nearest to the band.

    ``texts`` holds row, of_edited and terms (distinct). Nearness is the ratio of a term's frequency to the nearer end,
    ties go by hash; a term that ``counts`` does not hold is in one document.
    """
    rows = texts.select("row", "of_edited", F.explode("terms").alias("term"))
    known = counts.select(F.col("term").alias("c_term"), "count")
    n = F.coalesce(F.col("count"), F.lit(1))
    away = F.greatest(F.lit(1.0), F.lit(float(ends[0])) / n, n / F.lit(float(ends[1])))
    counted = rows.join(known, F.col("term") == F.col("c_term"), "left").select("row", "of_edited", "term", away.alias("away"))
    place = F.row_number().over(Window.partitionBy("row", "of_edited").orderBy("away", "term"))
    return counted.withColumn("place", place).where(F.col("place") <= LEAST_TERMS).select("row", "of_edited", "term")


def sub_hashes(terms: Column, mask: Column, mine: Column) -> list[Column]:
    """One aggregate per sub-lexicon: the combined hash of the terms that are in it (null: none).

    Terms arrive distinct and sorted; the combination by exclusive or does not depend on how a shuffle orders them.
    """
    return [
        F.bit_xor(F.when(mine & (F.shiftright(mask, k).bitwiseAND(F.lit(1)) == 1), F.xxhash64(terms, F.lit(k)))) for k in range(KINDS)
    ]


def render(hashes: Column, text_digest: Column) -> Column:
    """A group of 8 hex digits per sub-lexicon, `-` for an empty sub-lexicon; a text without any term of the lexicon shows its own digest."""
    parts = F.transform(hashes, lambda h: F.when(h.isNull(), F.lit("-")).otherwise(F.lower(F.lpad(F.hex(h), 16, "0").substr(1, 8))))
    empty = F.forall(hashes, lambda h: h.isNull())
    return F.when(empty, F.concat(F.lit("="), F.substring(text_digest, 1, 16))).otherwise(F.array_join(parts, "."))


def likeness(left: Column, right: Column) -> Column:
    """The best density's share of equal groups among those not empty on both sides (of half its draws at least).

    A text keeps about one term in a sub-lexicon of the density that suits its length, and there the share of equal
    groups follows the share of common terms. Equal fingerprints: 1.
    """
    pairs = F.arrays_zip(F.split(left, r"\.").alias("l"), F.split(right, r"\.").alias("r"))
    shares = []
    for d in range(len(DENSITIES)):
        used = F.filter(F.slice(pairs, d * DRAWS + 1, DRAWS), lambda p: (p["l"] != "-") | (p["r"] != "-"))
        same = F.size(F.filter(used, lambda p: p["l"] == p["r"]))
        shares.append(same / F.greatest(F.size(used), F.lit(DRAWS // 2)))
    whole = left.startswith("=") | right.startswith("=")
    return F.when(left == right, F.lit(1.0)).when(whole, F.lit(0.0)).otherwise(F.greatest(*shares))


def halves(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited, tie, next_doc_id, next_tie: the last half of the text replaced by the first of the next document."""
    base = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.sha2(F.col("text"), 256))
    paired = with_next(base, "doc_id", ["tie"], ["text", "doc_id", "tie"])
    n = F.char_length("text")
    edited = halves(F.col("text"), F.coalesce("next_text", F.lit("")))
    return paired.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "tie", "next_doc_id", "next_tie", F.col("row_place").alias("row"))


def membership(terms: DataFrame) -> Callable[[Column], Column]:
    """Whether each of a text's terms is in ``terms``, looked up in a sorted array that every worker holds."""
    held = terms.sparkSession.sparkContext.broadcast(np.sort(terms.select("l_term").toPandas()["l_term"].to_numpy(np.int64)))

    @F.arrow_udf("array<boolean>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = held.value
        for batch in batches:
            values, ends = batch.flatten().to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            hit = lexicon[np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)] == values if len(lexicon) else np.zeros(len(values), bool)
            yield pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(hit))

    return listed


def with_masks(both: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """row, key, term, of_edited, l_term, mask: the terms of both texts, and the sub-lexicons of those that the lexicon holds.

    A lexicon too large to broadcast as a table is held as bare hashes: joined by a shuffle, each term would carry its text's key
    there, and after it a text's hashes would be scattered over all tasks.
    """
    own, new = term_hashes(F.col("text")), term_hashes(F.col("edited"))
    n = terms.count()
    if MAX_BROADCAST < n <= MAX_HELD:
        listed = membership(terms)
        parts = both.select("row", *key, own.alias("own"), new.alias("new"))
        parts = parts.withColumns({"own_in": listed(F.col("own")), "new_in": listed(F.col("new"))})

        def side(name: str, edited: bool) -> Column:
            pairs = F.arrays_zip(F.col(name).alias("term"), F.col(f"{name}_in").alias("within"))
            return F.transform(pairs, lambda x: F.struct(x["term"].alias("term"), F.lit(edited).alias("of_edited"), x["within"].alias("within")))

        rows = parts.select("row", *key, F.explode_outer(F.concat(side("own", False), side("new", True))).alias("e")).select("row", *key, "e.*")
        held = rows.withColumn("l_term", F.when(F.col("within"), F.col("term")))
        return held.withColumn("mask", F.when(F.col("within"), masked(F.col("term")))).drop("within")
    own = F.transform(own, lambda t: F.struct(t.alias("term"), F.lit(False).alias("of_edited")))
    new = F.transform(new, lambda t: F.struct(t.alias("term"), F.lit(True).alias("of_edited")))
    rows = both.select("row", *key, F.explode_outer(F.concat(own, new)).alias("e")).select("*", "e.term", "e.of_edited")
    return rows.join(F.broadcast(terms) if n <= MAX_BROADCAST else terms, F.col("term") == F.col("l_term"), "left")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. Equal texts have equal fingerprints. Repeated ids follow each other by the digest of their
    text; rows equal in both come out once per row. One document is its own next. Empty input gives no rows.
    """
    with passing_tables(docs.sparkSession) as keep:
        prints = keep(_prints(docs, band))
    following = prints.groupBy(F.col("doc_id").alias("n_doc_id"), F.col("tie").alias("n_tie")).agg(F.first("fingerprint").alias("next_fingerprint"))
    paired = prints.join(following, F.col("next_doc_id").eqNullSafe(F.col("n_doc_id")) & (F.col("next_tie") == F.col("n_tie")), "left")
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).cast("double").alias("near_next"),
    )


def _prints(docs: DataFrame, band: tuple[float, float]) -> DataFrame:
    """doc_id, tie, n_chars, edited_sha256, next_doc_id, next_tie, fingerprint, edited_fingerprint, written once."""
    ends = edges_of(docs.count(), band)
    counts = written_once(frequencies(docs, 2 if ends[0] > 1 else 1), "imatch-terms")
    terms = in_band(counts, ends).select(F.col("term").alias("l_term"), "mask").persist()
    both = with_edited(docs).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    key = ["doc_id", "tie", "n_chars", "edited_sha256", "next_doc_id", "next_tie"]
    hit = with_masks(both, key, terms)
    here, there = ~F.col("of_edited"), F.col("of_edited")
    found = F.col("l_term").isNotNull()
    of = lambda side: F.count(F.when(side & F.col("term").isNotNull(), 1))
    short = lambda side: (F.count(F.when(side & found, 1)) < LEAST_TERMS) & (F.count(F.when(side & found, 1)) < of(side))
    prints = hit.groupBy("row", *key).agg(
        *[c.alias(f"a{k}") for k, c in enumerate(sub_hashes(F.col("term"), F.col("mask"), here))],
        *[c.alias(f"b{k}") for k, c in enumerate(sub_hashes(F.col("term"), F.col("mask"), there))],
        short(here).alias("short"),
        short(there).alias("edited_short"),
    )
    prints = prints.select(
        "row",
        *key,
        "short",
        "edited_short",
        render(F.array(*[f"a{k}" for k in range(KINDS)]), F.col("tie")).alias("fingerprint"),
        render(F.array(*[f"b{k}" for k in range(KINDS)]), F.col("edited_sha256")).alias("edited_fingerprint"),
    )
    prints = written_once(prints, "imatch-prints")
    terms.unpersist()
    lacking = prints.where("short or edited_short").select("row", "tie", "next_tie", "short", "edited_short")
    if not lacking.isEmpty():
        # Texts by digest, so that only those looked for are dealt again.
        needed = lacking.select(F.explode(F.array("tie", "next_tie")).alias("n_tie")).distinct()
        needed = F.broadcast(needed) if needed.count() <= MAX_BROADCAST // 10 else needed
        held = docs.select(whole_text().alias("text")).withColumn("h_tie", F.sha2(F.col("text"), 256))
        held = held.join(needed, F.col("h_tie") == F.col("n_tie"), "left_semi").dropDuplicates(["h_tie"])
        held = written_once(held, "imatch-texts")
        after = held.select(F.col("h_tie").alias("a_tie"), F.col("text").alias("next_text"))
        texts = lacking.join(held, F.col("tie") == F.col("h_tie")).join(after, F.col("next_tie") == F.col("a_tie"))
        texts = texts.withColumn("edited", halves(F.col("text"), F.col("next_text"))).select(
            "row",
            F.explode(
                F.array(
                    F.struct(F.lit(False).alias("of_edited"), F.when(F.col("short"), F.col("text")).alias("t")),
                    F.struct(F.lit(True).alias("of_edited"), F.when(F.col("edited_short"), F.col("edited")).alias("t")),
                )
            ).alias("e"),
        )
        texts = texts.where("e.t is not null").select("row", "e.of_edited", F.sha2("e.t", 256).alias("digest"), term_hashes(F.col("e.t")).alias("terms"))
        texts = written_once(texts, "imatch-short")
        discard(held)
        near = nearest_terms(texts, counts, ends).withColumn("mask", masked(F.col("term")))
        more = near.groupBy("row", "of_edited").agg(
            *[c.alias(f"a{k}") for k, c in enumerate(sub_hashes(F.col("term"), F.col("mask"), F.lit(True)))]
        )
        hashes = F.array(*[f"a{k}" for k in range(KINDS)])
        more = more.join(texts.select("row", "of_edited", "digest"), ["row", "of_edited"])
        more = more.select(F.col("row").alias("m_row"), "of_edited", render(hashes, F.col("digest")).alias("print"))
        more = more.groupBy("m_row").agg(
            F.max(F.when(~F.col("of_edited"), F.col("print"))).alias("own_print"), F.max(F.when(F.col("of_edited"), F.col("print"))).alias("new_print")
        )
        whole = prints.join(more, F.col("row") == F.col("m_row"), "left").select(
            *key,
            F.coalesce("own_print", "fingerprint").alias("fingerprint"),
            F.coalesce("new_print", "edited_fingerprint").alias("edited_fingerprint"),
        )
        prints = written_once(whole, "imatch-whole")
    return prints
