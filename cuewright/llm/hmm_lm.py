"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward recursion."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import remainder
from cuewright.session import written_once

#: The end token; no word is empty.
END = b""
#: Words with a class of their own (the most frequent ones), and classes shared by all other words: so many, and so many for
#: each unit of the square root of the vocabulary. Both grow with the corpus without end; what a round gathers does too.
OWN_CLASSES, OWN_GROWTH = 2048, 4
SHARED_CLASSES, SHARED_GROWTH = 1024, 1
#: Characters of text that one block of documents holds, about.
BLOCK_CHARS = 12_000_000
LN10 = float(np.log(10.0))


def classes_for(vocabulary: int) -> tuple[int, int]:
    """Own and shared classes for so many distinct training words."""
    root = math.isqrt(vocabulary)
    return OWN_CLASSES + OWN_GROWTH * root, SHARED_CLASSES + SHARED_GROWTH * root


def shared_class(word: bytes, own: int, shared: int) -> int:
    """The class of a word that is not frequent: by its last three bytes."""
    return own + zlib.crc32(word[-3:]) % shared


def _packed(classes: np.ndarray) -> bytes:
    """Two bytes a token while they suffice, else four; the first byte says which."""
    wide = len(classes) and classes.max() >= 1 << 16
    return (b"4" if wide else b"2") + zlib.compress(classes.astype(np.uint32 if wide else np.uint16).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), np.uint32 if packed[:1] == b"4" else np.uint16)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _encoded(docs: DataFrame, held_modulus: int, held: int) -> DataFrame:
    """Documents as token numbers of their block, and each block's words: one table with two kinds of rows.

    doc rows: block, doc_id, held_out, ids (int32 bytes); word rows: block, word, number, n (count in training documents).
    A block closes after about ``BLOCK_CHARS`` characters, which bounds its dictionary.
    """
    rows = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), held_modulus) == held).alias("held_out")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def closed(block: int, numbers: dict, seen: list) -> pd.DataFrame:
            n = np.zeros(len(numbers), np.int64)
            for ids in seen:
                n += np.bincount(ids, minlength=len(numbers))
            return pd.DataFrame({"block": block, "word": list(numbers), "number": np.arange(len(numbers), dtype=np.int32), "n": n})

        block, size, numbers, seen = 0, 0, None, []
        for batch in batches:
            for lo in range(0, len(batch), 500):
                piece = batch.iloc[lo : lo + 500]
                out = []
                for doc_id, text, held_out in zip(piece["doc_id"], piece["text"], piece["held_out"]):
                    if numbers is None:
                        numbers = _Numbers()
                    words = tokens(text)
                    words.append(END)
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    size += len(text or "")
                    if not held_out:
                        seen.append(ids)
                    out.append((part * (1 << 32) + block, doc_id, held_out, zlib.compress(ids.tobytes(), 1)))
                    if size >= BLOCK_CHARS:
                        yield pd.DataFrame(out, columns=["block", "doc_id", "held_out", "ids"]).astype({"doc_id": "Int64"})
                        yield closed(part * (1 << 32) + block, numbers, seen)
                        block, size, numbers, seen, out = block + 1, 0, None, [], []
                if out:
                    yield pd.DataFrame(out, columns=["block", "doc_id", "held_out", "ids"]).astype({"doc_id": "Int64"})
        if numbers is not None:
            yield closed(part * (1 << 32) + block, numbers, seen)

    fields = ["block", "doc_id", "held_out", "ids", "word", "number", "n"]

    def aligned(batches):
        for frame in run(batches):
            yield frame.reindex(columns=fields).astype({"doc_id": "Int64", "number": "Int32", "n": "Int64"})

    return rows.mapInPandas(aligned, "block long, doc_id long, held_out boolean, ids binary, word binary, number int, n long")


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __init__(self):
        super().__init__()
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.next()
        return value


class Hmm:
    """States with start and move probabilities, and class probabilities per state. Arrays of fixed size."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def drawn(cls, states: int, class_share: np.ndarray, seed: int) -> Hmm:
        """A random model near the class shares, with sticky states."""
        rng = np.random.default_rng(seed)
        emit = class_share[None, :] * rng.gamma(1.0, 1.0, (states, len(class_share))) + 1e-12
        move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def forward(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each sequence, by scaled forward recursion in lockstep over the documents."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order])
        logs, alpha = np.zeros(len(docs)), None
        emit = np.ascontiguousarray(self.emit.T)
        flat, starts = np.concatenate([docs[i] for i in order]), np.r_[0, np.cumsum(lengths)[:-1]]
        active = len(docs)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= t:
                active -= 1
            prior = np.broadcast_to(self.start, (active, len(self.start))) if t == 0 else alpha[:active] @ self.move
            alpha = prior * emit[flat[starts[:active] + t]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            logs[:active] += np.log(scale)
        out = np.empty(len(docs))
        out[order] = logs
        return out

    def expected(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch: expected starts, moves and emissions of the sequences, and their log likelihood."""
        s = len(self.start)
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order])
        flat, starts = np.concatenate([docs[i] for i in order]), np.r_[0, np.cumsum(lengths)[:-1]]
        emit = np.ascontiguousarray(self.emit.T)
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        alphas, scales, total = [], [], 0.0
        alpha = None
        for t in range(longest):
            a = active[t]
            prior = np.broadcast_to(self.start, (a, s)) if t == 0 else alpha[:a] @ self.move
            alpha = prior * emit[flat[starts[:a] + t]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            alphas.append(alpha)
            scales.append(scale)
            total += float(np.log(scale).sum())
        first, moves = np.zeros(s), np.zeros((s, s))
        gammas = np.empty((len(flat), s))
        beta = np.ones((len(docs), s))
        for t in range(longest - 1, -1, -1):
            a = active[t]
            gammas[starts[:a] + t] = alphas[t] * beta[:a]
            if t == 0:
                first = gammas[starts[:a]].sum(0)
                break
            seen = emit[flat[starts[:a] + t]] * beta[:a] / scales[t][:, None]
            moves += alphas[t - 1][:a].T @ seen
            beta[:a] = seen @ self.move.T
        moves *= self.move
        emits = np.stack([np.bincount(flat, gammas[:, k], minlength=self.emit.shape[1]) for k in range(s)])
        return first, moves, emits, total

    @classmethod
    def from_counts(cls, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, class_share: np.ndarray) -> Hmm:
        """Maximisation, smoothed: emissions lean on the class shares, moves and starts on equal shares."""
        emit = emits + 2.0 * class_share[None, :] + 1e-9
        move, start = moves + 0.1, first + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _lockstep(frame: pd.DataFrame, most: int = 500_000) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Cut a batch into groups of at most about ``most`` tokens, by length: sequences of a group end at about the same step."""
    docs = [_unpacked(b) for b in frame["classes"]]
    order = np.argsort([len(d) for d in docs], kind="stable")
    lo, size = 0, 0
    for i, at in enumerate(order):
        size += len(docs[at])
        if size >= most or i == len(order) - 1:
            mine = order[lo : i + 1]
            yield frame.iloc[mine], [docs[j].astype(np.int64) for j in mine]
            lo, size = i + 1, 0


def expected_counts(coded: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Baum-Welch pass: each task sums its documents, the tasks' sums are added by key; the result has a fixed size."""
    s, v = model.emit.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, moves, emits, total = np.zeros(s), np.zeros((s, s)), np.zeros((s, v)), 0.0
        for batch in batches:
            for _, docs in _lockstep(batch):
                f, m, e, t = model.expected(docs)
                first, moves, emits, total = first + f, moves + m, emits + e, total + t
        table = np.concatenate([np.r_[first[i], moves[i], emits[i]] for i in range(s)] + [np.array([total])])
        used = np.flatnonzero(table)
        yield pd.DataFrame({"at": used, "x": table[used]})

    sums = coded.where("not held_out").select("classes").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    table = np.zeros(s * (1 + s + v) + 1)
    got = sums.toPandas()  # at most s * (1 + s + v) + 1 rows
    table[got["at"]] = got["x"]
    rows = table[:-1].reshape(s, 1 + s + v)
    return rows[:, 0], rows[:, 1 : 1 + s], rows[:, 1 + s :], float(table[-1])


def coded_documents(docs: DataFrame, held_modulus: int = 7, held: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The documents as class sequences with the counts that need no states, and the classes' shares of training tokens.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, inside (log10 of the tokens' shares of their classes),
    classes. A word's share of its class is (c + 1) / (sum of c + 1 over the class, plus 1 for unknown words of a shared class).
    """
    stored = written_once(_encoded(docs, held_modulus, held), "hmm-encoded")
    words = stored.where("word is not null").select("block", "word", "number", "n")
    totals = words.groupBy("word").agg(F.sum("n").alias("c"))
    totals = written_once(totals, "hmm-words")
    sums = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = int(sums[0]), int(sums[1])
    # The most frequent words, a multiple of the square root of the vocabulary: half a million of a billion.
    n_own, n_shared = classes_for(v)
    top = totals.where("c > 0").orderBy(F.col("c").desc(), F.hex("word")).limit(n_own).select("word").toPandas()["word"]
    own = {bytes(w): i for i, w in enumerate(top)}
    base_den = float(np.log10(n + v + 1.0))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["class"] = np.array([own.get(w) if w in own else shared_class(w, n_own, n_shared) for w in map(bytes, batch["word"])], np.int32)
            yield batch

    classed = totals.mapInPandas(classify, "word binary, c long, class int")
    per = classed.where("c > 0").groupBy("class").agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("c")).toPandas()  # a row per class
    mass = np.zeros(n_own + n_shared)
    mass[per["class"]] = per["m"]
    mass[n_own:] += 1.0
    share = np.zeros(n_own + n_shared)
    share[per["class"]] = per["c"]
    share = (share + 0.5) / (share + 0.5).sum()
    log_mass = np.log10(np.maximum(mass, 1.0))
    known = classed.select(F.col("word").alias("k_word"), "c", "class")
    numbered = words.select("block", "word", "number").join(known, F.col("word") == F.col("k_word")).select(F.col("block").alias("of_block"), "number", "c", "class")

    def code(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, of = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        c[right["number"]], of[right["number"]] = right["c"], right["class"]
        log_c = np.log10(c + 1.0)
        inside = np.where((of < n_own) & (c > 0), 0.0, log_c - log_mass[of])
        rows = []
        for doc_id, held_out, packed in zip(left["doc_id"], left["held_out"], left["ids"]):
            ids = np.frombuffer(zlib.decompress(packed), np.int32)
            rows.append(
                (
                    doc_id,
                    held_out,
                    len(ids),
                    int((c[ids] > 0).sum()),
                    n,
                    float(log_c[ids].sum()) - len(ids) * base_den,
                    float(inside[ids].sum()),
                    _packed(of[ids]),
                )
            )
        out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "inside", "classes"])
        return out.astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, inside double, classes binary"
    texts = stored.where("word is null").select("block", "doc_id", "held_out", "ids")
    coded = texts.groupBy("block").cogroup(numbered.groupBy("of_block")).applyInPandas(code, schema)
    return written_once(coded, "hmm-coded"), share


def train(coded: DataFrame, share: np.ndarray, states: int = 8, rounds: int = 4, seed: int = 1) -> tuple[Hmm, list[float]]:
    """Baum-Welch rounds over all training documents; without any, the model stays as it was drawn."""
    model, history = Hmm.drawn(states, share, seed), []
    for _ in range(rounds):
        first, moves, emits, total = expected_counts(coded, model)
        if not first.sum():
            break
        model = Hmm.from_counts(first, moves, emits, share)
        history.append(total)
    return model, history


def score(docs: DataFrame, states: int = 8, rounds: int = 4, held_modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    ``score`` is the log10 probability of the whole token sequence: classes by the hidden states, words by their share
    of the class. Null and empty texts are the end token alone. Repeated rows are documents of their own. Empty input
    gives no rows; without training documents every word is unknown.
    """
    coded, share = coded_documents(docs, held_modulus, held)
    model, _ = train(coded, share, states, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, sequences in _lockstep(batch):
                out = rows.drop(columns=["inside", "classes"])
                out["score"] = model.forward(sequences) / LN10 + rows["inside"].to_numpy()
                yield out.astype({"doc_id": "Int64"})

    return coded.mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
