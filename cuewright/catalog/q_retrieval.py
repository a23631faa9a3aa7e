"""Retrieval: dense, sparse, fused, approximate; context."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cuewright import fixed_values as fv
from cuewright.catalog import sql_bits as sb
from cuewright.catalog import views
from cuewright.catalog.q_timing import chunks as all_chunks
from cuewright.catalog.registry import ORACLES, SQL_VIEWS, query
from cuewright.functions import numbers as num
from cuewright.operators import neighbour_graph, player, postings, pruned, retrieval
from cuewright.session import passing_tables, scratch_path, written_once

# ---- dense -----------------------------------------------------------------------------------
SQL_VIEWS["v_dense"] = """
  SELECT query_id, video_id, chunk_id, score, rn - 1 AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM (
      SELECT q.chunk_id AS query_id, q.video_id, c.chunk_id,
        round(least(1.0, greatest(0.0, (1 + list_inner_product(q.vec, c.vec) / sqrt(list_inner_product(q.vec, q.vec) * list_inner_product(c.vec, c.vec))) / 2)), 12) AS score
      FROM v_vectors q JOIN v_vectors c USING (video_id))) WHERE rn <= 30
"""
SQL_VIEWS["v_dense_kept"] = """
  SELECT query_id, video_id, chunk_id, score, rank FROM (
    SELECT *, count(*) FILTER (score >= 0.75) OVER (PARTITION BY query_id) AS ok FROM v_dense) WHERE score >= 0.75 OR (ok = 0 AND rank < 3)
"""


def _dense(spark, sf):
    return pruned.nearest_pruned(views.vectors(spark, sf), views.vector_queries(spark, sf), fv.FETCH_K, digits=12)


@query("dense_topk", "SELECT * REPLACE (round(score, 6) AS score) FROM v_dense")
def dense_topk(spark, sf):
    return _dense(spark, sf).withColumn("score", F.round("score", 6))


@query("dense_threshold", "SELECT * REPLACE (round(score, 6) AS score) FROM v_dense_kept")
def dense_threshold(spark, sf):
    return retrieval.dense_threshold(_dense(spark, sf), 0.75).withColumn("score", F.round("score", 6))


@query(
    "web_trigger",
    """SELECT q.vec_id AS query_id, mode, round(coalesce(top_score, 0.0), 6) AS top_score,
         CASE WHEN mode = 'always' OR (mode = 'auto' AND coalesce(top_score, 0.0) < 0.55) THEN mode END AS triggered_by
       FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'auto' ELSE 'always' END AS mode FROM embeddings) q
       LEFT JOIN (SELECT query_id, max(score) AS top_score FROM v_dense_kept WHERE chunk_id <> query_id GROUP BY query_id) t ON t.query_id = q.vec_id""",
)
def web_trigger(spark, sf):
    q = F.col("query_id")
    modes = views.vector_queries(spark, sf).select(
        "query_id", F.when(q % 3 == 0, "off").when(q % 3 == 1, "auto").otherwise("always").alias("mode")
    )
    ranked = retrieval.dense_threshold(_dense(spark, sf), 0.75).where(F.col("chunk_id") != q)
    return retrieval.web_trigger(modes, ranked).withColumn("top_score", F.round("top_score", 6))


@query("ann_topk")
def ann_topk(spark, sf):
    return retrieval.ann_topk(views.vectors(spark, sf), views.vector_queries(spark, sf), fv.FINAL_K)


@query(
    "ann_graph_recall",
    """SELECT 'l' || label AS video_id, count(*) AS queries, (count(*) * least(count(*), 10))::BIGINT AS found, true AS recalled FROM embeddings GROUP BY label""",
)
def ann_graph_recall(spark, sf):
    """What the stored neighbour graph finds of the exact neighbours, per video: nine tenths at least."""
    path = scratch_path(spark, "graph")
    vectors, asked = views.vectors(spark, sf), views.vector_queries(spark, sf)
    neighbour_graph.build(vectors, path)
    found, _ = neighbour_graph.search(spark, path, asked, fv.FINAL_K)
    exact = pruned.nearest_pruned(vectors, asked, fv.FINAL_K).select("video_id", "query_id", "chunk_id", F.lit(1).alias("hit"))
    counted = found.join(exact, ["video_id", "query_id", "chunk_id"], "left").groupBy("video_id")
    counted = counted.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("found"), F.count("hit").alias("hits"))
    return counted.select("video_id", "queries", "found", (F.col("hits") >= 0.9 * F.col("found")).alias("recalled"))


# ---- sparse ----------------------------------------------------------------------------------
SQL_VIEWS["v_tokens"] = """
  SELECT video_id, chunk_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS term FROM v_corpus
"""
SQL_VIEWS["v_tf"] = "SELECT video_id, chunk_id, term, count(*) AS tf FROM v_tokens GROUP BY ALL"
SQL_VIEWS["v_len"] = "SELECT video_id, chunk_id, count(*) AS len FROM v_tokens GROUP BY ALL"
SQL_VIEWS["v_bm25_videos"] = """
  SELECT c.video_id, count(*) AS n_chunks, sum(coalesce(len, 0)) / count(*)::DOUBLE AS avg_len FROM v_corpus c LEFT JOIN v_len USING (video_id, chunk_id) GROUP BY c.video_id
"""
SQL_VIEWS["v_bm25_terms"] = """
  SELECT video_id, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY video_id) ELSE raw END AS idf FROM (
    SELECT video_id, term, df, ln(n_chunks - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (
      SELECT video_id, term, count(*) AS df FROM v_tf GROUP BY video_id, term) JOIN v_bm25_videos USING (video_id))
"""
SQL_VIEWS["v_asked"] = """
  SELECT query_id, video_id, term, count(*) AS times FROM (
    SELECT query_id, video_id, unnest(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS term FROM v_questions) GROUP BY ALL
"""
SQL_VIEWS["v_sparse"] = """
  SELECT query_id, video_id, chunk_id, score, rn - 1 AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM (
      SELECT q.query_id, q.video_id, c.chunk_id, coalesce(s, 0.0) AS score FROM v_questions q JOIN v_corpus c USING (video_id)
      LEFT JOIN (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS s
                 FROM v_asked JOIN v_bm25_terms USING (video_id, term) JOIN v_tf USING (video_id, term) JOIN v_len USING (video_id, chunk_id)
                 JOIN v_bm25_videos USING (video_id) GROUP BY query_id, chunk_id) m USING (query_id, chunk_id))) WHERE rn <= 30
"""


@query(
    "bm25_stats",
    "SELECT video_id, term, df, round(idf, 6) AS idf, n_chunks, round(avg_len, 6) AS avg_len FROM v_bm25_terms JOIN v_bm25_videos USING (video_id)",
)
def bm25_stats(spark, sf):
    videos, terms = retrieval.bm25_stats(views.corpus(spark, sf))
    return terms.join(videos, "video_id").select(
        "video_id", "term", "df", F.round("idf", 6).alias("idf"), "n_chunks", F.round("avg_len", 6).alias("avg_len")
    )


@query("bm25_topk", "SELECT * FROM v_sparse")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(views.corpus(spark, sf), views.questions(spark, sf))


@query("bm25_index_topk", "SELECT * FROM v_sparse")
def bm25_index_topk(spark, sf):
    """The same rows from a stored index, of which only the blocks that can matter are read."""
    path = scratch_path(spark, "postings")
    postings.write_postings(views.corpus(spark, sf), path)
    return postings.bm25_search(spark, path, views.questions(spark, sf))


@query("bm25_index_update", "SELECT * FROM v_sparse")
def bm25_index_update(spark, sf):
    """An index of other texts, brought up to date video by video, answers like a new one."""
    path, now = scratch_path(spark, "postings"), views.corpus(spark, sf)
    late = F.pmod(F.xxhash64("video_id"), F.lit(3))
    old = now.where(late != 0).withColumn("text", F.when(late == 1, F.upper("text")).otherwise(F.col("text")))
    gone = now.where(late == 2).withColumn("video_id", F.concat(F.lit("gone "), F.col("video_id")))
    postings.write_postings(old.unionByName(gone), path)
    changed = now.where(late != 2)
    stale = changed.select("video_id").unionByName(gone.select("video_id")).distinct()
    postings.write_postings(changed, path, replaced=stale)
    return postings.bm25_search(spark, path, views.questions(spark, sf))


# ---- questions put to the chunk index: chunks, hashed vectors, both rankings, fusion, citation -----
SQL_VIEWS["k_corpus"] = 'SELECT video_id, chunk_pos AS chunk_id, text, segment_start, segment_end, start, "end" FROM v_chunks'
SQL_VIEWS["k_questions"] = """
  SELECT 2 * conv_id AS query_id, 'v' || conv_id AS video_id, arg_min(text, turn) AS question FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT 2 * doc_id + 1, 'd' || doc_id, string_split(text, chr(10))[-1] FROM documents WHERE text IS NOT NULL
"""
for _name in ("tokens", "tf", "len", "bm25_videos", "bm25_terms", "asked", "sparse"):
    SQL_VIEWS[f"k_{_name}"] = re.sub(r"\bv_(corpus|questions|tokens|tf|len|bm25_videos|bm25_terms|asked)\b", r"k_\1", SQL_VIEWS[f"v_{_name}"])
_BUCKET = "('0x' || substr(md5(term), 1, 2))::INTEGER"
SQL_VIEWS["k_vectors"] = f"SELECT video_id, chunk_id, {_BUCKET} AS b, count(*)::DOUBLE AS n FROM k_tokens GROUP BY ALL"
SQL_VIEWS["k_asked_vectors"] = f"SELECT query_id, video_id, {_BUCKET} AS b, sum(times)::DOUBLE AS n FROM k_asked GROUP BY ALL"
SQL_VIEWS["k_dense"] = """
  SELECT query_id, video_id, chunk_id, score, rn - 1 AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM (
      SELECT q.query_id, q.video_id, c.chunk_id, round(least(1.0, greatest(0.0, (1 + coalesce(dot / (sqrt(qq) * sqrt(cc)), 0)) / 2)), 12) AS score
      FROM k_questions q JOIN k_corpus c USING (video_id)
      LEFT JOIN (SELECT query_id, chunk_id, sum(a.n * x.n) AS dot FROM k_asked_vectors a JOIN k_vectors x USING (video_id, b) GROUP BY query_id, chunk_id) d USING (query_id, chunk_id)
      LEFT JOIN (SELECT query_id, sum(n * n) AS qq FROM k_asked_vectors GROUP BY query_id) USING (query_id)
      LEFT JOIN (SELECT video_id, chunk_id, sum(n * n) AS cc FROM k_vectors GROUP BY video_id, chunk_id) n ON n.video_id = c.video_id AND n.chunk_id = c.chunk_id)) WHERE rn <= 30
"""
SQL_VIEWS["k_kept"] = """
  SELECT * FROM (SELECT *, count(*) FILTER (score >= 0.55) OVER (PARTITION BY query_id) AS ok FROM k_dense) WHERE score >= 0.55 OR (ok = 0 AND rank < 3)
"""
SQL_VIEWS["v_lists"] = """
  SELECT l.*, c.text FROM (SELECT query_id, video_id, chunk_id, rank, 0 AS list FROM k_kept UNION ALL
     SELECT query_id, video_id, chunk_id, rank, 1 FROM k_sparse) l JOIN k_corpus c USING (video_id, chunk_id)
"""
SQL_VIEWS["v_fused"] = """
  SELECT query_id, video_id, chunk_id, score, rn - 1 AS rank, text FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rn FROM (
      SELECT query_id, video_id, text, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min(list * 1000 + rank) AS seen,
             arg_max(chunk_id, list * 1000 + rank) AS chunk_id FROM v_lists GROUP BY query_id, video_id, text)) WHERE rn <= 10
"""


def _indexed(spark, sf):
    """Every chunk with its vector and its place in the video, written once as an index is."""
    with passing_tables(spark) as keep:
        encoded = retrieval.hash_vectors(all_chunks(spark, sf), kind="double").withColumnRenamed("chunk_pos", "chunk_id")
        return keep(written_once(encoded, "chunk-index"))


def _questions(spark, sf):
    """The first words of a conversation and the last line of a document, asked about their own video."""
    rows = views.table(spark, sf, "conversations").where("text is not null")
    talk = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    talk = talk.select((2 * F.col("conv_id")).alias("query_id"), F.concat(F.lit("v"), "conv_id").alias("video_id"), "question")
    docs = views.table(spark, sf, "documents").where("text is not null")
    docs = docs.select((2 * F.col("doc_id") + 1).alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("video_id"), F.element_at(F.split("text", "\n", -1), -1).alias("question"))
    # Read by every step of a search.
    return written_once(retrieval.hash_vectors(talk.unionByName(docs), text="question", kind="double"), "questions")


@query("rrf_fuse", "SELECT query_id, video_id, chunk_id, score, rank FROM v_fused")
def rrf_fuse(spark, sf):
    corpus, asked = _indexed(spark, sf), _questions(spark, sf)
    texts = corpus.select("video_id", "chunk_id", "text")
    names = corpus.select("video_id", "chunk_id", retrieval.text_key(F.col("text")).alias("text"))  # no text is returned
    dense = retrieval.dense_threshold(retrieval.nearest(corpus, asked, fv.FETCH_K, digits=12))
    both = dense.withColumn("list", F.lit(0)).unionByName(retrieval.bm25_topk(texts, asked).withColumn("list", F.lit(1)))
    return retrieval.rrf_fuse(both.drop("score").join(names, ["video_id", "chunk_id"])).drop("text")


def _hybrid(spark, sf, corpus=None):
    return retrieval.hybrid_retrieve(_indexed(spark, sf) if corpus is None else corpus, _questions(spark, sf))


@query("hybrid_retrieve", "SELECT * FROM v_fused")
def hybrid_retrieve(spark, sf):
    return _hybrid(spark, sf)


@query(
    "shown_sources",
    "SELECT query_id, video_id, chunk_id, rank FROM v_fused WHERE rank < 5",
)
def shown_sources(spark, sf):
    return _hybrid(spark, sf).where(F.col("rank") < fv.SHOWN_SOURCES).select("query_id", "video_id", "chunk_id", "rank")


@query(
    "build_context",
    """SELECT q.query_id, concat_ws(chr(10) || chr(10), '{policy}', CASE WHEN s <> '' THEN '{summary}' || s END,
         '{chunks}' || coalesce(c, '{none}'), CASE WHEN block <> '' THEN '{web}' || block END,
         CASE WHEN history <> '' THEN '{history}' || history END, '{question}' || question) AS context
       FROM k_questions q LEFT JOIN (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS c FROM v_fused GROUP BY query_id) f USING (query_id)
       LEFT JOIN (SELECT 'd' || doc_id AS video_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 4000) AS s FROM documents) m USING (video_id)
       LEFT JOIN (SELECT query_id, string_agg(title, chr(10) ORDER BY rank) AS block FROM v_shaped GROUP BY query_id) w USING (query_id)
       LEFT JOIN (SELECT conv_id AS query_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'Message: ' END
            || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, CASE role WHEN 'assistant' THEN 1200 ELSE 800 END), chr(10) ORDER BY turn) AS history
            FROM conversations GROUP BY conv_id) h USING (query_id)""",
)
def build_context(spark, sf):
    asked = _questions(spark, sf)
    summaries = views.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.col("text").alias("summary"))
    shaped = retrieval.shape_search_results(views.search_results(spark, sf), n=5)
    titles = F.sort_array(F.collect_list(F.struct("rank", "title")))
    web = shaped.groupBy("query_id").agg(F.array_join(F.transform(titles, lambda x: x["title"]), "\n").alias("block"))
    history = player.format_history(views.table(spark, sf, "conversations")).withColumnRenamed("conv_id", "query_id")
    return retrieval.build_context(asked, _hybrid(spark, sf), summaries, web, history)


ORACLES["build_context"] = (
    ORACLES["build_context"]
    .replace("{policy}", fv.CONTEXT_POLICY)
    .replace("{summary}", fv.CONTEXT_SUMMARY)
    .replace("{chunks}", fv.CONTEXT_CHUNKS)
    .replace("{none}", fv.CONTEXT_NO_CHUNKS)
    .replace("{web}", fv.CONTEXT_WEB)
    .replace("{history}", fv.CONTEXT_HISTORY.replace("'", "''"))
    .replace("{question}", fv.CONTEXT_QUESTION)
)


# ---- chunk tables ----------------------------------------------------------------------------
@query("scan_chunks")
def scan_chunks(spark, sf):
    """All chunks read back from the chunk store."""
    from cuewright.sources import sinks

    path = scratch_path(spark, "chunks")
    sinks.write_chunks(all_chunks(spark, sf), path)
    return sinks.read_chunks(spark, path)


@query("embed_chunks")
def embed_chunks(spark, sf):
    """The numbers in each chunk's vector that are not zero."""
    encoded = retrieval.embed_chunks(all_chunks(spark, sf), "hashing", "tf-256", kind="double")
    sized = encoded.select("video_id", "chunk_pos", "embedding_provider", "embedding_model", F.size("vec").alias("dims"), "vec")
    places = F.posexplode_outer("vec").alias("place", "weight")  # outer: else each text is encoded a second time, for a filter
    rows = sized.select("video_id", "chunk_pos", "embedding_provider", "embedding_model", "dims", places).where("weight <> 0")
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "source_payload",
    f"""SELECT query_id, f.video_id, rank, segment_start, segment_end, start, "end", f.text, 'subtitles' AS source,
         {sb.fmt_time('start')} || '-' || {sb.fmt_time('"end"')} AS label FROM v_fused f JOIN k_corpus c ON c.video_id = f.video_id AND c.chunk_id = f.chunk_id""",
)
def source_payload(spark, sf):
    """Citations: the ranked chunks with their own times."""
    corpus = _indexed(spark, sf)
    return player.source_payload(_hybrid(spark, sf, corpus).join(corpus.drop("text", "vec"), ["video_id", "chunk_id"]))


@query(
    "length_buckets",
    """SELECT video_id, seg_idx, seconds, rn - 1 AS rank, (rn - 1) // 4 AS batch_no FROM (
         SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(seconds * 1000), seg_idx) AS rn FROM (
           SELECT video_id, seg_idx, greatest(0.2::DOUBLE, duration) AS seconds FROM v_segments))""",
)
def length_buckets(spark, sf):
    items = views.segments(spark, sf).select(
        "video_id", "seg_idx", F.greatest(F.lit(0.2), F.col("duration")).alias("seconds")
    )
    return retrieval.length_buckets(items, 4)


@query("relevance", "SELECT query_id, chunk_id, round(2 - 2 * score, 6) AS distance, score AS relevance FROM (SELECT query_id, chunk_id, round(score, 6) AS score FROM v_dense)")
def relevance(spark, sf):
    distance = F.round(2 - 2 * F.round("score", 6), 6)
    return _dense(spark, sf).select(
        "query_id", "chunk_id", distance.alias("distance"), F.round(num.relevance(distance), 6).alias("relevance")
    )
