"""Quality classifier: factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import remainder

#: Hashed word features, then one feature per bin of each statistic.
WORD_BUCKETS = 1 << 14
BINS = 10
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "marks", "symbols", "bars", "distinct", "top_word", "lines", "repeated_lines", "declared_chars",
)
FEATURES = WORD_BUCKETS + len(STATISTICS) * (BINS + 1)
FACTORS = 8
#: Labelled documents that the classifier is fitted on, the ones with the smallest hashes of their ids.
SAMPLE = 4000


class _Buckets(dict):
    """Feature of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % WORD_BUCKETS
        return value


def features(text: str | None, n_chars: float, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word features, their counts, and the statistics of a whole text (null counts as empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    ids, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)), return_counts=True)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size, n = max(len(raw), 1), max(len(words), 1)
    lines = raw.split(b"\n")
    pick = lambda chars: byte[list(chars)].sum() / size
    values = (
        np.log1p(len(text or "")), np.log1p(len(words)), len(raw) / n, byte[65:91].sum() / size, byte[48:58].sum() / size,
        pick(b".,;:!?"), pick(b"#$%&*@^~<>{}[]\\"), pick(b"|"), len(ids) / n, counts.max(initial=0) / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(n_chars, 0.0)) if n_chars == n_chars else np.nan,
    )
    return ids, counts, np.array(values)


def rows_of(ids: np.ndarray, counts: np.ndarray, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words as normalised log counts, each statistic as the bin it falls into (nan: its own)."""
    x = np.log1p(counts)
    norm = np.sqrt((x * x).sum()) or 1.0
    bins = np.array([BINS if v != v else np.searchsorted(e, v, "right") for v, e in zip(values, edges)])
    at = WORD_BUCKETS + np.arange(len(values)) * (BINS + 1) + bins
    return np.r_[ids, at], np.r_[x / norm, np.full(len(values), 0.5)]


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, edges: np.ndarray):
        self.bias, self.weights, self.factors, self.edges = bias, weights, factors, edges

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1; half the square of the factor sums less the sum of squares is the sum over all pairs."""
        at = np.concatenate([a for a, _ in docs])
        x = np.concatenate([v for _, v in docs])
        starts = np.cumsum([0] + [len(a) for a, _ in docs[:-1]])
        vx = self.factors[at] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        linear = np.add.reduceat(self.weights[at] * x, starts)
        return 1 / (1 + np.exp(-(self.bias + linear + 0.5 * (sums * sums - squares).sum(1))))

    @classmethod
    def fitted(cls, docs: list, labels: np.ndarray, edges: np.ndarray, epochs: int = 25, rate: float = 0.05, seed: int = 1) -> FactorisationMachine:
        """Logistic loss by adaptive gradient steps over small batches, a pull to zero on all weights."""
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
        m = cls(np.log(share / (1 - share)), np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, FACTORS)), edges)
        seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3), 1e-3
        for _ in range(epochs if len(docs) else 0):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
                part = [docs[i] for i in batch]
                at, x = np.concatenate([a for a, _ in part]), np.concatenate([v for _, v in part])
                sizes = np.array([len(a) for a, _ in part])
                of = np.repeat(np.arange(len(part)), sizes)
                vx = m.factors[at] * x[:, None]
                sums = np.add.reduceat(vx, np.cumsum(sizes) - sizes)
                error = (m.score(part) - labels[batch]) / len(part)
                unique, back = np.unique(at, return_inverse=True)
                e = error[of] * x
                gw = np.bincount(back, e, len(unique)) + 1e-5 * m.weights[unique]
                gv = np.zeros((len(unique), FACTORS))
                np.add.at(gv, back, e[:, None] * (sums[of] - vx))
                gv += 1e-4 * m.factors[unique]
                seen_w[unique] += gw * gw
                seen_v[unique] += gv * gv
                seen_b += error.sum() ** 2
                m.weights[unique] -= rate * gw / np.sqrt(seen_w[unique])
                m.factors[unique] -= rate * gv / np.sqrt(seen_v[unique])
                m.bias -= rate * error.sum() / np.sqrt(seen_b)
        return m


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents outside the held-out part. Documents with both labels are left out."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
    known = known.where((F.col("y") == F.col("most")) & (remainder(F.col("doc_id"), modulus) != held))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("l_id"), "y")
    rows = _inputs(docs).join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "n_chars", "y")  # at most `sample` ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for batch in batches:
            out = [features(t, c, buckets) for t, c in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "ids": [o[0] for o in out], "counts": [o[1] for o in out], "stats": [o[2] for o in out]})

    got = rows.mapInPandas(run, "doc_id long, y int, ids array<int>, counts array<int>, stats array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    stats = np.array(got["stats"].tolist()).reshape(-1, len(STATISTICS))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.zeros((len(STATISTICS), BINS - 1))
    for i in range(len(STATISTICS)):
        column = stats[:, i][~np.isnan(stats[:, i])] if len(stats) else np.zeros(0)
        if len(column):
            edges[i] = np.quantile(column, cuts)
    data = [rows_of(np.array(i), np.array(c), s, edges) for i, c, s in zip(got["ids"], got["counts"], stats)]
    return FactorisationMachine.fitted(data, got["y"].to_numpy(float), edges)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Inputs of a score are the whole text and the declared length; never labels, language, source or id. Null texts score
    like empty ones. Without labelled rows every score is near one half.
    """
    model = train(docs, labels, modulus, held, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for batch in batches:
            scores = []
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                scores.append(model.score([rows_of(*features(t, c, buckets), model.edges) for t, c in zip(part["text"], part["n_chars"])]))
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"]})
            out["score"] = np.concatenate(scores) if scores else np.zeros(0)
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    rows = _inputs(docs).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
