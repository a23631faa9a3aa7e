"""SentencePiece encoding and decoding by suffix-array matching of all pieces and relaxation along the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MARK = "▁"
#: Between the words of an indexed batch; no piece holds it.
GAP = 1
#: Characters that one suffix array indexes, about, and characters of a text cut into words at a time.
INDEX_CHARS = 1_000_000
WINDOW_CHARS = 1_000_000
#: Distinct words remembered by a worker.
REMEMBERED = 500_000


class Pieces:
    """A vocabulary of merges: pieces by rank (smaller merges first), single bytes for characters without a piece."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        plain = [i for i, p in enumerate(pieces) if i not in set(byte_ids.values()) and not re.fullmatch(r"<unk>|</?s>", p)]
        self.id_of = {pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: (-scores[i], i))
        self.rank = np.full(len(pieces), -1, np.int64)
        for r, i in enumerate(order):
            self.rank[i] = r if len(pieces[i]) > 1 else -1
        # Runs of the word mark share one rank in some vocabularies; they merge last, from the left.
        self.runs = {len(p): i for p, i in self.id_of.items() if set(p) == {MARK}}
        self.length = np.array([len(p) for p in pieces], np.int64)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        return cls(names, [model.get_score(i) for i in range(n)], {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)})

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces (as left * n + right, sorted) whose concatenation is a piece, and that piece's rank."""
        n, found = len(self.pieces), []
        for p, i in self.id_of.items():
            if len(p) > 1 and p.strip(MARK):
                for cut in range(1, len(p)):
                    left, right = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                    if left is not None and right is not None:
                        found.append((left * n + right, self.rank[i]))
        found.sort()
        return np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int64)

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece the pair merges into; the largest number if there is none."""
        keys, ranks = self.merges
        want = left * len(self.pieces) + right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, ranks[at], np.iinfo(np.int64).max)

    @cached_property
    def spines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its last merge (left, right), and whether merging its characters gives the piece at all."""
        n = len(self.pieces)
        left, right, whole = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        for p, i in self.id_of.items():
            if len(p) == 1:
                whole[i] = True
        self.__dict__["spines"] = (left, right, whole)
        for size in range(2, int(self.length.max()) + 1):  # parts are shorter, so their spines are known
            cuts = []
            for p, i in self.id_of.items():
                if len(p) == size and p.strip(MARK):
                    for c in range(1, size):
                        x, y = self.id_of.get(p[:c]), self.id_of.get(p[c:])
                        if x is not None and y is not None and whole[x] and whole[y] and max(self.rank[x], self.rank[y]) < self.rank[i]:
                            cuts.append((x, y, i))
            if cuts:
                x, y, i = np.array(cuts, np.int64).T
                # The last merge joins the two pieces that would otherwise stand side by side for good.
                ok = self.stable(x, y, below=self.rank[i])
                left[i[ok]], right[i[ok]], whole[i[ok]] = x[ok], y[ok], True
        return left, right, whole

    def stable(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether a piece a followed by b stays so when all their characters are merged by rank.

        Merges go by rank, so a part of a's right edge lives from its own rank to the rank of the part it is merged
        into; likewise b's left edge. Going back in time, the pair across the border must never have had a merge that
        comes before the end of both parts (on equal ranks the left one comes first). ``below``: only merges before it count.
        """
        left, right, _ = self.spines
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        never = np.full(len(a), np.iinfo(np.int64).max) if below is None else below
        end_a, end_b = never.copy(), never.copy()
        fine, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            c = self.merge_rank(x, y)
            bad = (c < end_a[open_]) & (c <= end_b[open_])
            fine[open_[bad]] = False
            ra, rb = self.rank[x], self.rank[y]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            open_, x, y, ra, rb = open_[go], x[go], y[go], ra[go], rb[go]
            back_a = ra > rb
            i, j = open_[back_a], open_[~back_a]
            end_a[i], a[i] = ra[back_a], right[x[back_a]]
            end_b[j], b[j] = rb[~back_a], left[y[~back_a]]
        return fine

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, int, dict[str, int]]:
        """Pieces as big-endian 16-bit character codes, padded: sorted lower and upper search keys."""
        alphabet = {c: i + 2 for i, c in enumerate(sorted({c for p in self.id_of for c in p}))}
        width = int(max(len(p) for p in self.id_of))
        wanted = [i for p, i in self.id_of.items() if self.spines[2][i]]
        low, high = np.zeros((len(wanted), width), ">u2"), np.full((len(wanted), width), 0xFFFF, ">u2")
        for r, i in enumerate(wanted):
            codes = [alphabet[c] for c in self.pieces[i]]
            low[r, : len(codes)] = high[r, : len(codes)] = codes
        return np.array(wanted), _keys(low), _keys(high), width, alphabet


def _keys(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"S{codes.shape[1] * 2}").ravel()


class Encoder:
    """Encodes words of a batch; remembers the words it has seen up to a bound."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._forget()
        self.words = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cut(self, text: str) -> Iterator[list[str]]:
        """Words with the marks before them. No piece reaches over a border between them."""
        if not text:
            return
        text = (MARK + text).replace(" ", MARK)
        lo, hi = 0, WINDOW_CHARS
        while lo < len(text):
            found = self.words.findall(text, lo, hi)
            if hi < len(text):
                if len(found) == 1:
                    hi += hi - lo
                    continue
                found.pop()
            lo += sum(map(len, found))
            hi = lo + WINDOW_CHARS
            yield found

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [[words for words in self.cut(t or "")] for t in texts]
        fresh = {w for words in parts for ws in words for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = {w for words in parts for ws in words for w in ws}
        self._learn(sorted(fresh))
        out = []
        for words in parts:
            ids = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in words]
            out.append(_gathered(np.concatenate(ids) if ids else np.zeros(0, np.int64), self.start, self.size, self.flat))
        return out

    def _learn(self, fresh: list[str]) -> None:
        lo, chars = 0, 0
        for i, w in enumerate(fresh):
            chars += len(w) + 1
            if chars >= INDEX_CHARS or i == len(fresh) - 1:
                part = fresh[lo : i + 1]
                size, flat = self._encoded(part)
                first = len(self.flat)
                self.known.update(zip(part, range(len(self.start), len(self.start) + len(part))))
                self.start = np.r_[self.start, first + np.cumsum(size) - size]
                self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, flat]
                lo, chars = i + 1, 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the words, and their tokens one after the other."""
        p = self.p
        marks = np.array([len(w) - len(w.lstrip(MARK)) for w in words])
        # One mark stays with the word; the run before it is merged by itself.
        kept = [w[max(0, m - 1) :] if m < len(w) else "" for w, m in zip(words, marks)]
        sizes, tokens = self._relaxed(kept)
        extra = np.array([m if m == len(w) else max(0, m - 1) for w, m in zip(words, marks)])
        special = np.flatnonzero(extra)
        if not len(special):
            return sizes, tokens
        starts, counts, stay = np.cumsum(sizes) - sizes, sizes.copy(), np.ones(len(tokens), bool)
        places, values = [], []
        for i in special:
            run = int(extra[i])
            if sizes[i] and tokens[starts[i]] == self.p.runs.get(1, -1):  # the word's own mark stands alone: it joins the run
                run, stay[starts[i]] = run + 1, False
                counts[i] -= 1
            ids = self._run(run)
            counts[i] += len(ids)
            places += [starts[i]] * len(ids)
            values += ids
        left = np.cumsum(stay) - stay  # where a token stands once those that joined a run are gone
        left = np.r_[left, stay.sum()]
        return counts, np.insert(tokens[stay], left[np.array(places)], np.array(values, np.int32))

    def _run(self, n: int) -> list[int]:
        """Pieces of n marks: equal ranks merge from the left, so a piece grows while the next size exists."""
        runs, stack = self.p.runs, []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in runs:  # the leftmost neighbours that form a piece
                last = stack.pop()
                stack[-1] += last
        return [runs[k] for k in stack]

    def _relaxed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        wanted, low, high, width, alphabet = p.index
        other, n = len(alphabet) + 2, len(p.pieces)
        text = "\x00".join(words) + "\x00"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        uniq, back = np.unique(points, return_inverse=True)
        table = np.array([GAP if c == 0 else alphabet.get(chr(c), other) for c in uniq], ">u2")
        codes = table[back]
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        if any("\x00" in w for w in words):  # a null character is not a gap
            inside = np.ones(len(codes), bool)
            inside[first + lengths] = False
            codes[inside & (codes == GAP)] = other
        # Suffix array over the first `width` characters, which is all that pieces can tell apart.
        padded = np.r_[codes, np.full(width, GAP)].astype(">u2")
        keys = _keys(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        hits = hi - lo
        at = order[np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())]
        piece = np.repeat(wanted, hits)
        strange = np.flatnonzero(codes == other)  # no piece: one edge of one character
        at, piece = np.r_[at, strange], np.r_[piece, np.full(len(strange), -1)]
        word = np.searchsorted(first, at, "right") - 1
        place = at - first[word]
        by_place = np.argsort(place, kind="stable")
        at, piece, place = at[by_place], piece[by_place], place[by_place]
        step = np.where(piece >= 0, p.length[piece], 1)
        # last[i]: the token that ends before character i in the merged prefix; NONE: not reached yet, START: word start.
        none, start = -3, -2
        last = np.full(len(codes) + 1, none, np.int64)
        last[first] = start
        bounds = np.searchsorted(place, np.arange(int(lengths.max(initial=0)) + 1))
        whole = p.spines[2]
        for d in range(len(bounds) - 1):
            s = slice(bounds[d], bounds[d + 1])
            a, t, to = last[at[s]], piece[s], at[s] + step[s]
            ok = a != none
            free = (a < 0) | (t < 0)
            check = np.flatnonzero(ok & ~free)
            if len(check):
                pair = a[check] * n + t[check]
                unique, inverse = np.unique(pair, return_inverse=True)
                ok[check] = p.stable(unique // n, unique % n)[inverse]
            single = ok & (t >= 0) & (a < 0)
            ok[single] = whole[t[single]]
            last[to[ok]] = t[ok]
        # Walk back from the ends of all words at once.
        end, rows, found = first + lengths, np.arange(len(words)), []
        live = lengths > 0
        rows, here = rows[live], end[live]
        while len(rows):
            token = last[here]
            found.append((rows, here, token))
            here = here - np.where(token >= 0, p.length[token], 1)
            go = here > first[rows]
            rows, here = rows[go], here[go]
        if not found:
            return np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        rows, here, token = (np.concatenate([f[i] for f in found]) for i in range(3))
        by_text = np.argsort(here, kind="stable")
        rows, here, token = rows[by_text], here[by_text], token[by_text]
        plain = token >= 0
        if plain.all():
            return np.bincount(rows, minlength=len(words)), token.astype(np.int32)
        out, counts = [], np.zeros(len(words), np.int64)
        spelled = {int(c): [p.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(points[here[~plain] - 1])}
        many = np.ones(len(token), np.int64)
        many[~plain] = [len(spelled[int(c)]) for c in points[here[~plain] - 1]]
        np.add.at(counts, rows, many)
        out = np.empty(many.sum(), np.int32)
        where = np.cumsum(many) - many
        out[where[plain]] = token[plain]
        for i in np.flatnonzero(~plain):
            ids = spelled[int(points[here[i] - 1])]
            out[where[i] : where[i] + len(ids)] = ids
        return counts, out


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    n = size[ids]
    return flat[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def decode(pieces: Pieces, ids: np.ndarray | list[int]) -> str:
    """The text of token ids: marks are spaces, the first one is dropped; control tokens are nothing, broken bytes U+FFFD."""
    byte_of = {i: bytes([b]) for b, i in pieces.byte_ids.items()}
    plain = set(pieces.id_of.values())
    raw = b"".join(byte_of[i] if i in byte_of else pieces.pieces[i].encode() if i in plain else b"" for i in map(int, ids))
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, and token_ids (array<int>), n_tokens, round_trip (the ids decode to the text).

    A null text has null ids, 0 tokens and a true round trip; an empty one has no ids. U+2581 in a text decodes to a
    space, as in the format itself, and gives a false round trip. Rows come out as they came in, repeated or not.
    """
    pieces = Pieces.load(model_path)
    pieces.index  # noqa: B018  made once here, sent to the tasks
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(pieces)
        table = Decoder(pieces)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = encoder.texts(texts)
                fine = [t is None or table.text(i) == t for t, i in zip(texts, ids)]
                nulls = np.array([t is None for t in texts])
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(nulls))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(fine, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "token_ids", "n_tokens", "round_trip"])

    from pyspark.sql import functions as F

    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("string").alias("text_"))
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, narrow.schema.fields))
    out = narrow.mapInArrow(run, f"{kinds}, token_ids array<int>, n_tokens long, round_trip boolean")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "token_ids", "n_tokens", "round_trip")


class Decoder:
    """Bytes of every token in one buffer, joined by gathers."""

    def __init__(self, pieces: Pieces):
        byte_of = {i: bytes([b]) for b, i in pieces.byte_ids.items()}
        plain = set(pieces.id_of.values())
        raw = [
            byte_of[i] if i in byte_of else p.replace(MARK, " ").encode() if i in plain else b"" for i, p in enumerate(pieces.pieces)
        ]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        text = _gathered(ids.astype(np.int64), self.start, self.size, self.flat).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text
