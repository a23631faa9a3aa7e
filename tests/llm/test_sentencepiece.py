import random

import pytest
import sentencepiece

from cuewright.llm import sentencepiece_sa as sa
from cuewright.llm.queries import PIECE_MODEL
from tests.llm.helpers import clashing, edges, table

PARTS = [*"abcdeth n   \n\t\r.,;(){}'\"0123456789éßü日本語한😀\x01\x00", "   ", "the ", "    ", "ing", "tion", "\r\n", "▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sa.Pieces.load(PIECE_MODEL)


def test_same_ids_as_the_library(library, pieces):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [a + " " * k + b for k in range(50) for a in ("", "x") for b in ("", "the", "日")] + ["A Quick brown fox's 12,345 tests.", "", "supercalifragilistic"]
    texts = [t for t in texts if "\x00" not in t] + ["a\x00b"]
    ids = sa.Encoder(pieces).texts(texts)
    table_ = sa.Decoder(pieces)
    for text, mine in zip(texts[:-1], ids):
        want = library.encode(text)
        assert list(mine) == want, text
        assert table_.text(mine) == sa.decode(pieces, mine) == library.decode(want)
    assert table_.text(ids[-1]) == "a\x00b"


def test_small_windows_and_forgetting(library, pieces, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)] + ["q" * 500]
    for name, value in (("WINDOW_CHARS", 37), ("INDEX_CHARS", 50), ("REMEMBERED", 200)):
        monkeypatch.setattr(sa, name, value)
    encoder = sa.Encoder(pieces)
    for lo in range(0, len(texts), 7):
        assert [list(i) for i in encoder.texts(texts[lo : lo + 7])] == library.encode(texts[lo : lo + 7])


def test_suffix_array_relaxation_on_a_toy_vocabulary():
    toy = sa.Pieces(["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "<0x63>"], [0, -9, -9, -9, -1, -2, -3, -4, 0], {99: 8})
    encode = lambda t: [toy.pieces[i] for i in sa.Encoder(toy).texts([t])[0]]
    assert encode("abab") == ["▁", "ab", "ab"] and encode("aba") == ["▁", "aba"] and encode("bab") == ["▁", "b", "ab"]
    assert encode("ac") == ["▁a", "<0x63>"]


def test_operator_edges(spark, library):
    df = clashing(edges(spark), "token_ids", "text_")
    out = sa.encode_documents(df, PIECE_MODEL, ["doc_id", "text", "token_ids"])
    assert out.columns[:3] == ["doc_id", "text", "token_ids"]
    rows = out.toDF("doc_id", "text", "x", "ids", "n_tokens", "round_trip").collect()
    assert len(rows) == 11
    for r in rows:
        assert (r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or [])
        if r.text is not None:
            assert list(r.ids) == library.encode(r.text)
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert sa.encode_documents(table(spark, []), PIECE_MODEL, ["doc_id"]).count() == 0
