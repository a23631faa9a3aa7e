import random

import numpy as np

from cuewright.llm import jaccard_join
from cuewright.llm.components import components
from tests.llm.helpers import clashing, edges, table, words


def plain_sets(rows, k):
    out = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def plain_components(rows, k, percent):
    sets = plain_sets(rows, k)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in best[find(i)] if x is not None), default=None) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def got(df, k, percent):
    groups = jaccard_join.jaccard_groups(df, k, percent).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, groups.collect()), key=repr)


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[] if len(w) > 1 else [w[i]], ["new%d" % rng.randrange(999)], [w[i], "more"]])
    return " ".join(w)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = words(rng, rng.choice([3, 9, 11, 25, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 1, 1, 2, 4, 8])), "en", "s", 1))
    chain = words(rng, 120)  # neighbours are linked, the ends are not
    for i in range(8):
        rows.append((len(rows), chain, "en", "s", 1))
        chain = edited(rng, chain, 2)
    for k, percent in ((3, 90), (5, 80), (3, 60)):
        assert got(table(spark, rows), k, percent) == plain_components(rows, k, percent)


def test_one_shared_passage_and_hot_copies(spark):
    rng = random.Random(6)
    passage, copy = words(rng, 40, 9000), words(rng, 80, 9000)
    rows = [(i, words(rng, 40, 9000) + " " + passage, "en", "s", 1) for i in range(40)]
    rows += [(100 + i, copy if i % 3 else copy + f" tail{i}", "en", "s", 1) for i in range(60)]
    assert got(table(spark, rows), 3, 90) == plain_components(rows, 3, 90)


def test_edges(spark):
    rows = [tuple(r) for r in edges(spark).collect()]
    assert got(clashing(edges(spark), "node", "cell"), 3, 90) == plain_components(rows, 3, 90)
    assert got(edges(spark).limit(0), 3, 90) == []
    kept = jaccard_join.one_of_each(clashing(edges(spark), "node"), 5, 80)
    assert kept.columns == [*edges(spark).columns, "node"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 1, 2, 3, 4, 6, 7, 8, 9], key=repr)


def test_linked_sets_share_a_needed_cell():
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        rings = jaccard_join.SizeRings(percent)
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 99, 100, 101, 333, 1200):
            for _ in range(30):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                most = n * 100 // percent - n if rng.random() < 0.5 else 0  # either only additions or exchanges too
                add = rng.integers(0, most + 1) if most else 0
                drop = 0 if most else int(n * (100 - percent) / (100 + percent))
                y = np.unique(np.r_[x[drop:], rng.integers(0, 2**63, add + drop).astype(np.uint64)])
                common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                if 100 * common >= percent * union and common < union:
                    seed = int(rng.integers(1 << 30))  # any order of the cells, the same for both
                    order = lambda c: np.argsort(jaccard_join.mixed(c.view(np.uint64) + np.uint64(seed)))
                    first = [{(r, int(v)) for r, need, c in rings.cells(s) for v in c[order(c)][:need]} for s in (x, y)]
                    assert first[0] & first[1], (percent, n, add, drop)


def near_group(rng, n, size, edits, prefix="", pool=40):
    """Copies of a text with so many words exchanged each, for words of their own or out of ``pool``."""
    base, out = words(rng, size, 100_000).split(), []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(size), edits):
            w[at] = f"{prefix}{rng.randrange(pool)}" if rng.random() < 0.3 else f"{prefix}{i}x{at}"
        out.append(" ".join(w))
    return out


def test_large_regions_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    rng = random.Random(9)
    texts = [t for size, edits in ((60, 2), (90, 3), (90, 1), (40, 3)) for t in near_group(rng, 45, size, edits)]
    texts += [t + " " + words(rng, 12, 9000) for t in near_group(rng, 30, 100, 0)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for k, percent in ((3, 90), (5, 80), (2, 70)):
        assert got(table(spark, rows), k, percent) == plain_components(rows, k, percent)


def test_alike_but_not_linked_is_linear_work(spark, monkeypatch):
    """Sub-regions of a group whose members are all alike and hardly linked: their rows grow with the group (4 times here), not with its square (16 times)."""
    monkeypatch.setattr(jaccard_join, "SMALL", 24)
    rows = []
    for n in (500, 2000):
        rng = random.Random(11)
        docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(near_group(rng, n, 120, 5, pool=n // 10))])
        regions = jaccard_join._regions(jaccard_join._cells(docs, 3, 90))
        large = regions.join(regions.groupBy("cell").count().where(f"count > {jaccard_join.SMALL}"), "cell").drop("count")
        links, left = jaccard_join._around(large, jaccard_join._sets(docs, 3), 90)
        parts = jaccard_join._parts(left, spark.createDataFrame([], "id long, component long"))
        rows.append((regions.count(), links.count(), parts.count()))
        members = [r.n for r in parts.groupBy("cell").agg({"node": "count"}).toDF("cell", "n").collect()]
        assert max(members, default=0) <= 0.6 * n
    assert all(b <= 8 * a for a, b in zip(*rows)), rows


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(7, 7)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    assert out == {x: find(x) for x in label if find(x) != x}
