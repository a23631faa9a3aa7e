import hashlib
import random
import zlib

import pytest

from cuewright.llm import prefix_trie
from tests.llm.helpers import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_order(rows):
    """conv_id -> its turns (role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv, []).append(((turn is not None, turn or 0), tie, (role, text)))
    return {c: [t[2] for t in sorted(v)] for c, v in out.items()}


def plain_graft(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, mine in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in mine if len(convs[c]) == len(path))
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(mine), len(path), parent, len(mine), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(nodes):
    return sorted(map(tuple, nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed=1, n=40, longest=30):
    rng, rows = random.Random(seed), []
    starts = [[("system", "be kind"), ("user", "größe?")], [("system", "be kind")], []]
    long = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(longest)]
    for c in range(n):
        turns = list(rng.choice(starts))
        turns += long[: rng.randrange(longest)] if c % 3 == 0 else [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc"])) for _ in range(rng.randrange(6))]
        rows += [(c, i if rng.random() > 0.05 else None, *t) for i, t in enumerate(turns)]
    rows += [r for r in rows if r[0] == 3]  # every turn twice
    rows += [(1000 + c, i, *t) for c in range(12) for i, t in enumerate(long)]  # a group of copies
    return rows + [(-3, 0, "user", "a"), (-5, 0, "user", "a"), (-5, 1, "user", "bb"), (None, 0, "user", "lost")]


@pytest.mark.parametrize("block", [1, 3, 8])
def test_against_plain_trie(spark, block):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.turn_rows(clashing(df, "place", "digest", "depth"))
    convs = plain_order(rows)
    assert got(prefix_trie.prefix_nodes(turns, turns.select("conv_id").distinct(), block)) == plain_nodes(convs)
    assert got(prefix_trie.prefix_nodes(*prefix_trie.grafted(turns, 5, 9), block)) == plain_nodes(plain_graft(convs))


def test_long_scans_and_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SCAN_BLOCKS", 2)
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 5)
    rows = conversations(2, 20, 25)
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.prefix_nodes(turns, turns.select("conv_id").distinct(), 3)) == plain_nodes(plain_order(rows))


def test_turnless_and_empty(spark):
    rows = [(1, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.turn_rows(df)
    convs = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    assert got(prefix_trie.prefix_nodes(turns, convs)) == plain_nodes({1: [("user", "a")], 2: [], 3: []})
    none = prefix_trie.turn_rows(df.limit(0))
    assert got(prefix_trie.prefix_nodes(none, convs)) == plain_nodes({1: [], 2: [], 3: []})
    assert got(prefix_trie.prefix_nodes(none, convs.limit(0))) == []


def test_last_turns(spark):
    rows = conversations(3, 8, 10)
    convs = plain_order(rows)
    for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None))
