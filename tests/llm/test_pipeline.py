"""The pipeline against plain versions of its stages, and the registered queries against SQL and brute force."""

import importlib
from pathlib import Path

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from cuewright.llm import mixing, queries
from tests.llm import test_jaccard_join as jaccard
from tests.llm import test_line_runs as lines
from tests.llm.helpers import edges, rows_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_copies", "mixing", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, DATA)
    assert first.columns == docs.columns and first.where("length(text) > 100").count() == docs.where("length(text) > 100").count()
    second = stages["line_dedup"](spark, first, DATA)
    rows = [tuple(r) for r in first.collect()]
    want = {r[0]: r[3] for r in lines.plain(rows, 40, 5)}
    got = second.collect()
    assert second.columns == docs.columns and {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    third = stages["near_copies"](spark, second, DATA)
    groups = jaccard.plain_components([tuple(r) for r in got], 5, 80)
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, _, component in groups if d == component)
    fourth = stages["mixing"](spark, third, DATA)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(third).collect()}
    copies = fourth.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {d: round(t / s + 1e-9) for d, (t, s) in taken.items() if s and round(t / s + 1e-9)}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = {r.doc_id: r.text for r in fourth.collect()}
    out = stages["tokens"](spark, fourth, DATA).collect()
    assert len(out) == fourth.count() and all(r.token_ids == library.encode(texts[r.doc_id]) for r in out)


def test_edge_rows_pass_all_stages(spark):
    docs = edges(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() >= 0
    empty = edges(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.execute(f"create view {name_of} as select * from '{DATA}/{name_of}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    rel = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    want = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in rel.fetchall()), key=repr)
    assert rows_of(df) == want


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert importlib.util.find_spec("cuewright.catalog") and corpus_pipeline.ORACLE_SQL is None
