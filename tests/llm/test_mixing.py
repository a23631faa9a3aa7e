from collections import defaultdict
from fractions import Fraction

import pytest

from cuewright.llm import mixing
from tests.llm.helpers import clashing, edges, rows_of, table


def plain_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """Reshare the excess again and again, with exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        w = sum(weight[s] for s in open_)
        now = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if now[s] > cap * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: Fraction(cap * sizes[s]) for s in over}


def docs(spark, sizes):
    rows, n = [], 0
    for source, counts in sizes.items():
        for c in counts:
            rows.append((n, " ".join(["w"] * c), "en", source, 2 * c))
            n += 1
    return table(spark, rows)


def test_targets_and_taken(spark):
    sizes = {"a": [50, 10, 700], "b": [3000, 20, 5], "c": [10], "d": [400] * 12, None: [1], "é": [90, 90]}
    got = mixing.mix(docs(spark, sizes), block=64).collect()
    want = plain_targets({s: sum(c) for s, c in sizes.items()})
    taken, size = defaultdict(int), {}
    for r in got:
        assert r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] = r.source_size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 and size[s] == sum(sizes[s])
    assert rows_of(mixing.mix(docs(spark, sizes), block=64)) == sorted(map(tuple, got), key=repr)


def test_schedule_interleaves_and_is_whole(spark):
    targets = table(spark, [("a", 9000, 6000.0), ("b", 9000, 2500.0), (None, 10, 3.0)], "source string, source_size long, target double")
    slots = sorted(mixing.schedule(targets, 100).collect(), key=lambda r: r.slot)
    for source, take in (("a", 6000), ("b", 2500), (None, 3)):
        mine = [r for r in slots if r.source == source]
        assert sum(r.words for r in mine) == take and [r.rank for r in mine] == list(range(len(mine)))
    # Every stretch holds each source nearly in proportion.
    for lo in range(0, 80, 10):
        part = [r for r in slots if lo <= r.slot < lo + 10]
        assert abs(sum(r.source == "a" for r in part) - 10 * 60 / 86) <= 2


def test_edges(spark):
    got = mixing.mix(clashing(edges(spark), "size", "start", "taken")).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[1] == 0
    assert mixing.mix(edges(spark).limit(0)).count() == 0
    only_empty = edges(spark).where("doc_id in (1, 2)")
    assert [r.taken for r in mixing.mix(only_empty).collect()] == [0, 0]
    mixed = mixing.mixed_documents(clashing(edges(spark), "m_id"))
    assert mixed.columns == [*edges(spark).columns, "m_id"]
    assert {r.doc_id for r in mixed.collect()} <= {None, 4, 5, 6, 7, 8, 9}
