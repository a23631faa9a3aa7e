import hashlib
import random

import xxhash

from cuewright.llm import imatch
from cuewright.llm.common import with_next
from tests.llm.helpers import clashing, edges, table, words


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def h64(text, seed=42):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=seed))


def edited(rows):
    """Texts with the last half replaced by the next document's first half, in order of id and text digest."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest()))
    out = []
    for place, i in enumerate(order):
        text, after = rows[i][1] or "", rows[order[(place + 1) % len(order)]][1] or ""
        half = len(text) // 2
        out.append((rows[i][0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark):
    rng = random.Random(1)
    rows = [(d * 3, words(rng, rng.randint(0, 30)) + " é日", "en", "s", 1) for d in range(300)]
    for cut in (rows, rows[:1], [*rows[:5], (None, "no id", "en", "s", 1), (0, "again zero", "en", "s", 1), rows[0]]):
        out = imatch.fingerprints(clashing(table(spark, cut), "tie", "row", "mask")).select("doc_id", "n_chars", "edited_sha256").collect()
        assert sorted(map(tuple, out), key=repr) == edited(cut)


def test_lexicon_band_and_sub_hashes(spark):
    rng = random.Random(2)
    rows = [(d, words(rng, 40, 200), "en", "s", 1) for d in range(200)]
    texts = {r[0]: set(r[1].split()) for r in rows}
    df = {}
    for t in texts.values():
        for w in t:
            df[w] = df.get(w, 0) + 1
    band = (0.05, 0.3)
    want = {h64(w) for w, n in df.items() if band[0] * 200 <= n <= band[1] * 200}
    lexicon = {r.term: r.mask for r in imatch.lexicon(table(spark, rows), band).collect()}
    assert set(lexicon) == want and len(want) > 20
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(table(spark, rows), band).collect()}
    salted = lambda t, k: signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest((t % (1 << 64)).to_bytes(8, "little"), seed=42)))
    for d in range(20):
        mine = [h64(w) for w in texts[d] if h64(w) in lexicon]
        for k, part in enumerate(prints[d].split(".")):
            chosen = [t for t in mine if lexicon[t] >> k & 1]
            value = 0
            for t in chosen:
                value ^= salted(t, k) % (1 << 64)
            assert part == (f"{value:016x}"[:8] if chosen else "-")


def test_likeness_orders_documents(spark):
    rng = random.Random(3)
    base = words(rng, 120, 3000).split()
    near = base[:-3] + ["w1", "w2", "w3"]
    half = base[:60] + words(rng, 60, 3000).split()
    other = words(rng, 120, 3000).split()
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate([base, base, near, base, half, base, other])]
    rows += [(100 + i, words(rng, 120, 3000), "en", "s", 1) for i in range(200)]
    out = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows), (0.005, 0.9)).collect()}
    assert out[0].near_next == 1.0 and out[0].fingerprint == out[1].fingerprint == out[3].fingerprint
    assert out[1].near_next > out[3].near_next > out[5].near_next
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())


def test_edges(spark):
    out = imatch.fingerprints(edges(spark)).collect()
    assert len(out) == 11
    by = {(r.doc_id, r.n_chars): r for r in out}
    assert by[(1, 0)].fingerprint == by[(2, 0)].fingerprint and by[(4, 25)].fingerprint == by[(5, 25)].fingerprint
    assert imatch.fingerprints(edges(spark).limit(0)).count() == 0


def test_next_over_many_buckets(spark):
    df = spark.range(0, 5000, 7).selectExpr("id as doc_id", "cast(id as string) as text")
    got = {r.doc_id: r.next_text for r in with_next(df, "doc_id", ["text"], ["text"], rows_per_bucket=50).collect()}
    ids = list(range(0, 5000, 7))
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_near_copies_that_hold_a_third_of_the_rows(spark):
    rng = random.Random(5)
    base = [f"c{i}" for i in range(60)]
    rows = []
    for d in range(600):
        if d < 200:
            text = base[:-2] + [f"x{d}", f"y{d}"]
        else:
            text = words(rng, 60, 3000).split()
        rows.append((d, " ".join(text), "en", "s", 1))
    out = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows)).collect()}
    assert len(out) == 600
    near = [out[d].near_next for d in range(199)]
    assert sum(near) / 199 > 0.6 and not any(out[d].fingerprint.startswith("=") for d in range(200))


def test_least_terms_and_lower_end(spark):
    assert imatch.edges_of(10_000_000, imatch.BAND) == (imatch.FREQUENT, 1_000_000.0)
    assert imatch.edges_of(200, (0.05, 0.3)) == (10.0, 60.0)
    counts = table(spark, [(t, n) for t, n in ((1, 50), (2, 500), (3, 200), (4, 5), (5, 900))], "term long, count long")
    texts = table(spark, [(7, False, [1, 2, 3, 4, 5, *range(6, 40)])], "row long, of_edited boolean, terms array<long>")
    got = sorted(r.term for r in imatch.nearest_terms(texts, counts, (10.0, 100.0)).collect())
    assert got == list(range(1, imatch.LEAST_TERMS + 1))
