import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuewright.llm import merkle
from tests.llm.helpers import clashing, edges, table, words


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return digest(*map(framed, (doc_id, source, lang, n_chars, text)))


def plain_tree(digests, fanout):
    """root, and for every leaf the siblings (left, right) on the way up."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for leaf, pos in enumerate(at):
            run, i = runs[pos // fanout], pos % fanout
            steps[leaf].append((run[:i], run[i + 1 :]))
            at[leaf] = pos // fanout
        digests = [digest(*run) for run in runs]
    return (digests[0] if digests else None), steps


def plain_proofs(rows, fanout):
    """doc_id, leaf, subroot, root, siblings as one string: sorted."""
    null_first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = []
    for g in order:
        mine = sorted(((r[0], plain_leaf(r)) for r in groups[g]), key=lambda x: (null_first(x[0]), x[1]))
        built.append((mine, *plain_tree([leaf for _, leaf in mine], fanout)))
    root, upper = plain_tree([b[1] for b in built], fanout)
    out = []
    for (mine, subroot, steps), above in zip(built, upper):
        for (doc_id, leaf), way in zip(mine, steps):
            out.append((doc_id, leaf, subroot, root, "".join("".join(a + b) for a, b in way + above)))
    return sorted(out, key=repr)


def proofs(df, fanout=8, **keep):
    leaf = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return merkle.proofs(df, leaf, F.col("lang"), {"doc_id": F.col("doc_id")}, keep, fanout)


def got(df, fanout=8):
    out = proofs(df, fanout).select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("s"))
    return sorted(map(tuple, out.collect()), key=repr)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i // 2 if i % 11 == 0 else i, words(rng, 5), rng.choice(langs), "s", i) for i in range(n)]


@pytest.mark.parametrize("n,langs,fanout", [(150, ["en", "de", None, "Zz"], 2), (700, ["en", "en", "en", "fr"], 8), (65, ["en"], 8), (40, [f"l{i:02d}" for i in range(30)], 3)])
def test_against_plain_tree(spark, n, langs, fanout):
    rows = corpus(n, langs)
    assert got(table(spark, rows), fanout) == plain_proofs(rows, fanout)


def test_every_jump_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "JUMP_ROWS", -1)
    rows = corpus(90, ["en", "de"], 4)
    assert got(table(spark, rows), 2) == plain_proofs(rows, 2)


def test_edges(spark):
    rows = [tuple(r) for r in edges(spark).collect()]
    assert got(clashing(edges(spark), "leaf", "tree", "row_number", "d"), 2) == plain_proofs(rows, 2)
    for n in (0, 1):
        assert got(edges(spark).limit(n)) == plain_proofs(rows[:n], 8)
    copies = [(7, "same", "en", "s", 4)] * 50
    assert got(table(spark, copies)) == plain_proofs(copies, 8)
    with pytest.raises(ValueError):
        proofs(edges(spark), root=F.lit(1))


def test_tampering_is_found(spark):
    rows = corpus(100, ["en", "de"], 3)
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = proofs(table(spark, rows), 4, changed=F.when(hit, leaf(F.concat("text", F.lit("!")))).otherwise(leaf(F.col("text"))))
    out = made.select("doc_id", merkle.folded(F.col("changed"), F.col("proof")).alias("f"), "root").collect()
    assert {r.doc_id for r in out if r.f == r.root} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3}
