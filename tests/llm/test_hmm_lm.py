import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cuewright.llm import hmm_lm
from tests.llm.helpers import clashing, edges, table


def small_model(seed=1, states=3, classes=5):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return hmm_lm.Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def by_paths(model, seq):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], seq[t]]
        total += p
    return total


def test_forward_is_exact():
    model = small_model()
    docs = [np.array(d) for d in ([0], [4, 1, 2], [1, 1, 0, 3, 2, 4], [2, 3], [0, 0, 0, 0, 1])]
    assert np.allclose(model.forward(docs), [np.log(by_paths(model, d)) for d in docs])
    assert sum(by_paths(model, list(s)) for s in itertools.product(range(5), repeat=3)) == pytest.approx(1)


def test_expected_counts_by_paths():
    model, docs = small_model(2), [np.array(d) for d in ([1, 4, 2, 0], [3], [0, 2])]
    first, moves, emits, total = model.expected(docs)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))]
    for d in docs:
        z = by_paths(model, d)
        for path in itertools.product(range(3), repeat=len(d)):
            p = model.start[path[0]] * model.emit[path[0], d[0]]
            for t in range(1, len(d)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], d[t]]
            want[0][path[0]] += p / z
            for t in range(len(d)):
                want[2][path[t], d[t]] += p / z
                if t:
                    want[1][path[t - 1], path[t]] += p / z
    assert all(np.allclose(a, b) for a, b in zip((first, moves, emits), want))
    assert total == pytest.approx(model.forward(docs).sum())


def corpus(n=120):
    rng, rows = random.Random(4), []
    for d in range(n):
        topic = [[f"aa{i}" for i in range(30)], [f"bb{i}" for i in range(30)]][d % 2]
        rows.append((d, " ".join(rng.choice(topic) for _ in range(rng.randint(0, 40))).replace("aa1 ", "AA1\n"), "en", "s", 1))
    return rows


def test_scores_against_plain_counts(spark):
    rows = corpus() + [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (501, "", "en", "s", 1), (None, "unseen zz", "en", "s", 1)]
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    out = hmm_lm.score(clashing(table(spark, rows), "block", "word", "c"), states=4).collect()
    want = sorted(((r[0], held(r[0]), len(tok(r[1])), sum(w in c for w in tok(r[1])), n) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out), key=repr) == want
    texts = dict((r[0], r[1]) for r in rows)
    for r in out:
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tok(texts[r.doc_id])))
        assert np.isfinite(r.score) and r.score < 0
    long = [r for r in out if r.held_out and r.n_tokens > 10]
    assert np.mean([r.score > r.base_score for r in long]) > 0.9


def test_training_does_not_lose_likelihood_and_model_is_normalised(spark):
    coded, share = hmm_lm.coded_documents(table(spark, corpus()))
    assert share.sum() == pytest.approx(1)
    _, history = hmm_lm.train(coded, share, states=4, rounds=5)
    assert all(b >= a - 30 for a, b in zip(history, history[1:])) and history[-1] > history[0]


def test_classes_grow_with_the_vocabulary(spark, monkeypatch):
    sizes = [sum(hmm_lm.classes_for(v)) for v in (10**3, 10**5, 10**7, 10**9)]
    assert sizes == sorted(set(sizes)) and sizes[-1] > 10 * sizes[1]
    for classes in (np.array([], np.int64), np.array([0, 65_535]), np.array([3, 65_536])):
        assert hmm_lm._unpacked(hmm_lm._packed(classes)).tolist() == classes.tolist()
    monkeypatch.setattr(hmm_lm, "OWN_CLASSES", 10)
    monkeypatch.setattr(hmm_lm, "SHARED_CLASSES", 5)
    _, share = hmm_lm.coded_documents(table(spark, corpus()))
    assert len(share) == sum(hmm_lm.classes_for(61)) and share.sum() == pytest.approx(1)


def test_no_training_document(spark):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:5]
    out = hmm_lm.score(table(spark, [(d, "some words", "en", "s", 1) for d in held]), states=2).collect()
    assert len(out) == 5 and all(r.held_out and r.n_known == 0 and np.isfinite(r.score) for r in out)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = corpus(40)
    whole = sorted(map(tuple, hmm_lm.score(table(spark, rows), states=2).select("doc_id", "n_known", "base_score").collect()))
    monkeypatch.setattr(hmm_lm, "BLOCK_CHARS", 200)
    parts = sorted(map(tuple, hmm_lm.score(table(spark, rows).coalesce(1), states=2).select("doc_id", "n_known", "base_score").collect()))
    assert [p[:2] for p in parts] == [w[:2] for w in whole] and np.allclose([p[2] for p in parts], [w[2] for w in whole])


def test_edges(spark):
    assert hmm_lm.score(edges(spark), states=2, rounds=2).count() == 11
    assert hmm_lm.score(edges(spark).limit(0), states=2, rounds=2).count() == 0
