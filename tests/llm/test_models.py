"""Quality classifier, language identification, learned neighbours."""

import random
import zlib

import numpy as np
import pytest

from cuewright.llm import language_id, learned_ann, quality_fm
from tests.llm.helpers import clashing, edges, table, words


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(1)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, 4)), None)
    docs = [(np.array([3, 9, 70, 5000]), np.array([0.5, 1.0, -2.0, 0.1])), (np.array([4]), np.array([1.0]))]
    for (at, x), got in zip(docs, m.score(docs)):
        pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert got == pytest.approx(1 / (1 + np.exp(-(m.bias + m.weights[at] @ x + pairs))))


def quality_rows(n=240):
    rng, docs, labels = random.Random(8), [], []
    for d in range(n):
        bad = d % 4 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words(rng, rng.randint(20, 80)).split())
        docs.append((d, text, "en", f"s{d % 3}", len(text)))
        labels.append((d, int(not bad), 0))
    return docs, labels


def test_quality_on_held_out_and_its_inputs(spark):
    docs, labels = quality_rows()
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_fm.score(clashing(table(spark, docs), "ids", "y"), label_table).collect()}
    held = [d for d in out if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(out[d].held_out == (d in held) for d in out) and len(held) > 30
    assert np.mean([out[d].predicted == labels[d][1] for d in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    # Neither labels of the held-out part nor language, source and id play a part.
    flipped = spark.createDataFrame([(d, 1 - q if d in held else q, t) for d, q, t in labels], label_table.schema)
    other = table(spark, [(d, t, "xx", "elsewhere", n) for d, t, _, _, n in docs])
    again = {r.doc_id: r.score for r in quality_fm.score(other, flipped).collect()}
    assert all(again[d] == pytest.approx(out[d].score, abs=1e-12) for d in out)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, None, 0), (7, 0, 1), (99, 1, 0)], none.schema)
    for labels in (none, odd):
        out = quality_fm.score(edges(spark), labels).collect()
        assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
        by = {r.doc_id: r.score for r in out}
        assert quality_fm.score(edges(spark).limit(0), labels).count() == 0
    assert by[4] == pytest.approx(by[5])
    assert quality_fm.score(edges(spark).drop("n_chars"), odd).count() == 11


SAYINGS = {
    "en": "the cat and the dog were sitting on the old wall when it rained".split(),
    "de": "der hund und die katze waren auf der alten mauer als es regnete".split(),
    "fr": "le chien et le chat étaient assis sur le vieux mur quand il pleuvait".split(),
}


def language_rows(n=150):
    rng = random.Random(5)
    langs = list(SAYINGS)
    return [(d, " ".join(rng.choice(SAYINGS[langs[d % 3]]) for _ in range(30)), langs[d % 3], f"src{d % 3}", 1) for d in range(n)]


def test_language_fusion(spark):
    model = language_id.train(table(spark, language_rows()))
    assert model.languages == ["de", "en", "fr"]
    rows = [(i, t, d, None, dom, h) for i, (t, d, dom, h) in enumerate([
        ("der alte hund und die katze", None, "a.com", "x.a.com"), ("das 123", None, "a.com", "x.a.com"), ("le chat et le chien", "fr", None, None),
        ("12345 !!!", "fr", None, None), ("", None, None, None), (None, "de", "a.com", "x.a.com"), ("ok", "fr", "b.fr", "www.b.fr"),
    ])]
    rows += [(100 + i, "le vieux chat et le chien assis sur le mur", "fr", "fr", "b.fr", "www.b.fr") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string")
    out = {r.id: r for r in language_id.identify(df, model).collect()}
    assert len(out) == 37 and out[0].lang == "de" and out[2].lang == "fr" and out[6].lang == "fr"
    assert [out[i].rejected for i in (0, 3, 4, 5)] == [False, True, True, True] and out[4].lang == "und"
    alone = {r.id: r for r in language_id.identify(df.where("id in (0, 2, 6)"), model).collect()}
    assert alone[6].probability < out[6].probability  # host, domain and declaration speak for French


def test_language_parts(spark):
    row = spark.range(1).selectExpr("'<!DOCTYPE html><html class=\"x\" lang=\"FR-ca\"><p>' as html", "'https://www.news.example.org:80/de/a?b' as url")
    got = row.select(
        language_id.declared_language(row.html).alias("d"), language_id.host_of(row.url).alias("h"),
        language_id.suffix_of(row.url).alias("s"), language_id.domain_of(language_id.host_of(row.url)).alias("m"),
    ).first()
    assert tuple(got) == ("fr", "www.news.example.org", "/de", "org.example")
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", ""), (3, "http://h.fr", "<p>le chat et le chien</p>")], "page_id long, url string, html string")
    model = language_id.train(table(spark, language_rows()))
    out = {r.page_id: r for r in language_id.identify(language_id.page_rows(pages), model).collect()}
    assert out[1].rejected and out[2].rejected and out[3].lang == "fr" and out[3].suffix == "fr"


def test_language_filter_keeps_clean_documents(spark):
    docs = table(spark, language_rows() + [(900, "", "en", "s", 0), (901, None, None, None, None), (None, "the old dog and the cat", "en", None, 1)])
    kept = language_id.accepted(clashing(docs, "g_id"))
    assert kept.columns == [*docs.columns, "g_id"]
    assert {r.doc_id for r in kept.collect()} == {None, *range(150)}
    assert language_id.accepted(docs.limit(0)).count() == 0
    assert language_id.accepted(edges(spark)).count() <= 11


def vectors(n=1500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    x[100:400] = x[50]  # a group of copies
    return x.astype(np.float32)


def test_neighbours_against_brute_force(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = learned_ann.search(clashing(df, "id", "v", "part"), df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20).collect()
    exact, hit = x.astype(float), 0
    for q in range(0, len(x), 20):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        score = (exact * exact[q]).sum(1)
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        hit += len(set(best) & {r.vec_id for r in mine})
    assert hit / (20 * 75) >= 0.9


def test_partitions_of_partitions_and_short_queries(spark, monkeypatch):
    monkeypatch.setattr(learned_ann, "LARGE_PART", 150)
    monkeypatch.setattr(learned_ann, "PART_ROWS", 40)
    monkeypatch.setattr(learned_ann, "PIECE_ROWS", 100)
    rng = np.random.default_rng(8)
    centres = 3 * rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 2400)] + rng.normal(size=(2400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = learned_ann.Index(df, "vec_id", "embedding", k=10, sample=400)
    assert made.levels and made.index.count() == 2400  # every row is indexed, once
    sizes = [r["count"] for r in made.index.groupBy("part").count().collect()]
    assert max(sizes) <= 400
    out = learned_ann.search(df, df.where("vec_id % 40 = 0"), "vec_id", "embedding", k=10, sample=400).collect()
    hit = 0
    for q in range(0, 2400, 40):
        mine = {r.vec_id for r in out if r.query_id == q}
        score = x @ x[q]
        score[q] = -np.inf
        assert len(mine) == 10
        hit += len(mine & set(np.argsort(-score)[:10].tolist()))
    assert hit / 600 >= 0.9
    products = made._asked(made._usable(df.where("vec_id % 40 = 0")), 1).join(made.index.groupBy("part").count(), "part").agg({"count": "sum"}).first()[0]
    assert products <= 0.6 * 60 * 2400  # clustered vectors: a share of all products
    few = learned_ann.search(df.where("vec_id < 60"), df.where("vec_id < 3"), "vec_id", "embedding", k=80).collect()
    assert all(sum(r.query_id == q for r in few) == 59 for q in range(3))


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(203, 8))
    sizes = np.bincount(learned_ann.balanced_parts(learned_ann.neighbour_graph(x, 6), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (40, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = learned_ann.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert learned_ann.search(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
