"""Language identification by fusing text likelihoods, declared markup language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import packed, whole_text
from cuewright.session import written_once

#: Hashed runs of three characters.
GRAMS = 1 << 16
#: Labelled documents that the text model is fitted on, those with the smallest hashes of their ids.
SAMPLE = 4000
#: Neighbouring runs depend on each other; their likelihood counts this much.
TEMPER = 0.25
#: Rows' worth of the parent's share that smooths a host, a domain, a declaration or a suffix.
LEAN = 5.0
#: Texts of this many runs can show that they are in none of the languages.
LONG_ENOUGH = 200
MAX_BROADCAST = 1_000_000


def grams(text: str | None) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text; ASCII that is no letter counts as a space, and spaces as one."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes < 97) | ((codes > 122) & (codes < 128))] = 32
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)


class TextModel:
    """Log likelihoods of trigrams per language, and the usual mean of a text's own language."""

    def __init__(self, languages: list[str], table: np.ndarray, floor: np.ndarray):
        self.languages, self.table, self.floor = languages, table, floor

    def logs(self, text: str | None) -> tuple[np.ndarray, int]:
        g = grams(text)
        total = np.zeros(len(self.languages))
        for lo in range(0, len(g), 65536):
            total += self.table[g[lo : lo + 65536]].sum(0, dtype=np.float64)
        return total, len(g)


def train(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Trigram counts per language over at most ``sample`` documents with a language, summed by Spark."""
    some = docs.where("lang is not null and text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = some.select(F.col("doc_id").alias("s_id")).distinct()
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"), "left_semi").select("lang", "text")  # at most `sample` ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                sums.setdefault(lang, np.zeros(GRAMS))
                np.add.at(sums[lang], grams(text), 1.0)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": used, "n": n[used]})

    counts = rows.mapInPandas(run, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((GRAMS, len(languages)), 0.5)
    floor = np.full(len(languages), -np.inf)
    for i, lang in enumerate(languages):
        mine = counts[counts["lang"] == lang]
        table[mine["gram"], i] += mine["n"]
        p = table[:, i] / table[:, i].sum()
        mean = float((p * np.log(p)).sum())
        floor[i] = (mean + float(np.log(0.5 / table[:, i].sum()))) / 2  # half way to a text of unseen runs alone
        table[:, i] = np.log(p)
    return TextModel(list(languages), table.astype(np.float32), floor)


def declared_language(markup: Column) -> Column:
    """Two-letter language of the first lang attribute of an html tag; null if there is none."""
    found = F.lower(F.regexp_extract(markup, r"(?i)<html[^>]{0,200}?\blang\s*=\s*[\"']?([a-z]{2})\b", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(found != "", found)


def suffix_of(url: Column) -> Column:
    """The language-like first part of the path (`/fr/`), else the last label of the host."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.element_at(F.split(host_of(url), r"\."), -1))


def domain_of(host: Column) -> Column:
    return F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, 2), ".")


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows without text, with logs (tempered log likelihoods), post (their posterior), n_runs and fits."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logs, posts, runs, fits = [], [], [], []
            for text in batch["text"]:
                total, n = model.logs(text)
                best = int(np.argmax(total)) if len(total) else 0
                tempered = TEMPER * (total - total.max(initial=-np.inf if len(total) else 0.0)) if len(total) else total
                p = np.exp(tempered)
                logs.append(tempered)
                posts.append(p / p.sum() if len(p) else p)
                runs.append(n)
                fits.append(bool(len(total)) and (n < LONG_ENOUGH or total[best] / n >= model.floor[best]))
            out = batch.drop(columns="text")
            yield out.assign(logs=logs, post=posts, n_runs=runs, fits=fits)

    return rows.mapInPandas(run, f"{schema}, logs array<double>, post array<double>, n_runs long, fits boolean")


def _sums(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Sum of the text posteriors per key: soft counts of languages, pre-aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias("soft"), F.count("*").alias("rows"))


def _shares(soft: Column, parent: Column) -> Column:
    total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(soft, parent, lambda s, p: (s + LEAN * p) / (total + LEAN))


def identify(rows: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """The columns of ``rows`` but text, and lang, probability, text_lang, rejected.

    ``rows``: text and nullable strings declared, suffix, domain, host beside any id columns. The posterior multiplies
    the text's likelihood, the host's prior, and what a declaration or suffix says about a language. Host priors are
    shares of soft counts in the host, smoothed by the domain, that by all rows; a row does not count for itself.
    Missing evidence is left out. Rejected: texts without any run of letters, whose best language has a probability
    under ``least``, or which fit none of the languages; they have the language und. Empty input gives no rows.
    """
    n = len(model.languages)
    scored = written_once(_scored(rows, model).where(F.lit(n > 0)), "language-scores")
    useful = scored.where("n_runs > 0 and fits")
    everything = useful.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(n)]).first() if n else []
    total = sum(everything) + n
    base = [(x + 1.0) / total for x in everything]
    whole = F.array(*[F.lit(p) for p in base])
    domains = _sums(useful.where("domain is not null"), n, "domain").select(F.col("domain").alias("d_key"), _shares(F.col("soft"), whole).alias("d_share"))
    hosts = _sums(useful.where("host is not null"), n, "host").select(F.col("host").alias("h_key"), F.col("soft").alias("h_soft"))
    declared = _sums(useful.where("declared is not null"), n, "declared").select(F.col("declared").alias("m_key"), _shares(F.col("soft"), whole).alias("m_share"))
    suffixes = _sums(useful.where("suffix is not null"), n, "suffix").select(F.col("suffix").alias("s_key"), _shares(F.col("soft"), whole).alias("s_share"))
    j = scored.join(hosts, F.col("host") == F.col("h_key"), "left").join(domains, F.col("domain") == F.col("d_key"), "left")
    j = j.join(declared, F.col("declared") == F.col("m_key"), "left").join(suffixes, F.col("suffix") == F.col("s_key"), "left")
    counted = (F.col("n_runs") > 0) & F.col("fits")
    others = F.zip_with("h_soft", "post", lambda s, p: F.when(counted, F.greatest(s - p, F.lit(0.0))).otherwise(s))
    prior = F.coalesce(_shares(others, F.coalesce("d_share", whole)), F.col("d_share"), whole)
    j = j.withColumn("prior", prior)
    flat = F.array(*[F.lit(1.0)] * n)
    says = lambda share: F.coalesce(F.zip_with(share, whole, lambda s, p: s / p), flat)
    j = j.withColumn("says", F.zip_with(says("m_share"), says("s_share"), lambda a, b: a * b))
    joint = F.zip_with(F.zip_with("prior", "says", lambda a, b: F.log(a * b)), "logs", lambda a, b: a + b)
    j = j.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    j = j.withColumn("odds", F.transform("joint", lambda x: F.exp(x - F.col("top"))))
    j = j.withColumn("probability", F.lit(1.0) / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in model.languages])
    j = j.withColumn("best", F.get(names, (F.array_position("joint", F.col("top")) - 1).cast("int")))
    j = j.withColumn("text_lang", F.get(names, (F.array_position("post", F.array_max("post")) - 1).cast("int")))
    j = j.withColumn("rejected", (F.col("n_runs") == 0) | ~F.col("fits") | (F.col("probability") < least))
    kept = [c for c in rows.columns if c != "text"]
    return j.select(*kept, F.when(F.col("rejected"), F.lit("und")).otherwise(F.col("best")).alias("lang"), "probability", "text_lang", "rejected")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as input of ``identify``: the source is the host, markup in the text may declare a language."""
    text = whole_text()
    nothing = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.xxhash64(text).alias("text_id"), text.alias("text"), declared_language(text).alias("declared"),
        nothing.alias("suffix"), nothing.alias("domain"), F.col("source").cast("string").alias("host"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages as input of ``identify``: the text is the markup without tags, scripts and styles."""
    html = whole_text("html")
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    url = F.col("url").cast("string")
    return pages.select(
        "page_id", visible.alias("text"), declared_language(html).alias("declared"), suffix_of(url).alias("suffix"),
        domain_of(host_of(url)).alias("domain"), host_of(url).alias("host"),
    )


def accepted(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``docs`` without the rows that language identification rejects; all columns stay."""
    model = model or train(docs)
    gone = identify(document_rows(docs), model).where("rejected").select(F.col("doc_id").alias("g_id"), F.col("text_id").alias("g_text")).distinct()
    gone = written_once(gone, "language-rejected")
    small = gone.count() <= MAX_BROADCAST
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("of_text"))
    match = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("of_text") == F.col("g_text"))
    return rows.join(F.broadcast(gone) if small else gone, match, "left_anti").select("row.*")
