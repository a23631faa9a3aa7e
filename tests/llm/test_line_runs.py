import hashlib
import random
import string

from cuewright.llm import line_runs
from tests.llm.helpers import clashing, edges, table

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, min_chars, min_docs):
    """doc texts with the repeated long lines dropped, by dictionaries."""
    where = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    low = -(1 << 63)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(low if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        mine = low if doc_id is None else doc_id
        lines = (text or "").split("\n")
        gone = lambda k: len(k) >= min_chars and len(where[k]) >= min_docs and mine < max(where[k])
        kept = [line for line in lines if not gone(key(line))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    rows = line_runs.dedup_lines(df, **options).select("doc_id", "ld_lines", "ld_dropped", "ld_text").collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_plain(spark):
    rng = random.Random(3)
    lines = [f"{'Line' if i % 2 else ' lINE'} number {i} É {'pad ' * (i % 4)}" for i in range(30)]
    rows = []
    for d in range(60):
        text = "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 12)))
        rows.append((d if d else None, text, "en", "s", 1))
    for batches, fanout in ((1, 4), (5, 2)):
        assert got(table(spark, rows), min_chars=16, min_docs=5, batches=batches, fanout=fanout) == plain(rows, 16, 5)


def test_edges(spark):
    df = clashing(edges(spark), "line", "place", "keeper")
    rows = [tuple(r) for r in edges(spark).collect()]
    assert got(df, min_chars=3, min_docs=2) == plain(rows, 3, 2)
    assert line_runs.dedup_lines(df).columns[: len(df.columns)] == df.columns
    assert got(edges(spark).limit(0)) == []


def test_many_places_of_one_document(spark):
    line = "a line that is long enough to count as one"
    rows = [(d, "\n".join([line] * (3000 if d == 1 else 1) + ["short"]), "en", "s", 1) for d in range(6)]
    out = got(table(spark, rows))
    assert [r[2] for r in out] == [1, 3000, 1, 1, 1, 0] and out[1][3] == "short"


def test_levels_and_anti_join(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    mine = lambda rows: spark.createDataFrame(rows, "line string, doc_id long")
    for batch in range(5):
        runs.add(mine([("a", batch), ("a", batch), (f"b{batch}", batch)]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = {r.line: (r.n_docs, r.keeper) for r in runs.rows().collect()}
    assert rows["a"] == (5, 4) and rows["b3"] == (1, 3)
    asked = mine([("a", 2), ("a", 4), ("b1", 1), ("new", 9)])
    assert sorted(r.doc_id for r in runs.survivors(asked, 5).collect()) == [1, 4, 9]
    assert [r.doc_id for r in runs.dropped(asked, 5).collect()] == [2]


def test_kept_text_hash(spark):
    rows = [(1, "x\ny", "en", "s", 3)]
    text = line_runs.dedup_lines(table(spark, rows)).first()["ld_text"]
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"x\ny").hexdigest()
