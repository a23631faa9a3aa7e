"""One query per operator over the provided tables, and SQL where it can state the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import hmm_lm, imatch, jaccard_join, language_id, learned_ann, line_runs, merkle, mixing, pii_feistel, prefix_trie, quality_fm, secret_links, sentencepiece_sa
from cuewright.llm.common import ascii_lower, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Where the public tokenizer's file lies on every machine; a parameter of the operator.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op4_pii_feistel")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, the values replaced by kind."""
    out = pii_feistel.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="demonstration key")
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long")
    kinds = [count(kind).alias(f"n_{kind}") for kind, _, _ in pii_feistel.KINDS]
    return out.select("doc_id", F.col("pii_text").alias("text"), F.size("pii_kinds").cast("long").alias("n_values"), *kinds)


MIX_SQL = r"""
WITH s AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('1:' || coalesce(doc_id::VARCHAR, '')) AS shuffle
    FROM documents
), p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
           1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total FROM p
), c AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap,
           2.0::DOUBLE * coalesce(sum(source_size) OVER r, 0)::BIGINT AS spent,
           (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER r, 0)::BIGINT AS open_weight
    FROM w WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, (total - spent) / open_weight AS level FROM c
), f AS (
    SELECT *, (SELECT level FROM l WHERE cap > level * weight ORDER BY cap / weight, source IS NULL, source LIMIT 1) AS final FROM l
), t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f
), d AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY shuffle, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, take) - start) + greatest(0, least(start + size, take - source_size) - start))::BIGINT AS taken
FROM d
"""


@query("op5_source_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, coalesce(k.doc_id < f.keeper, false) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_runs", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


@query("op8_imatch_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode_documents(documents(spark, sf_dir), PIECE_MODEL, ["doc_id"])


@query("op9_hmm_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(documents(spark, sf_dir).select("doc_id", "text"), held_modulus=7, held=2)


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op2_quality_fm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.7, modulus=4, held=2)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(language_id.document_rows(docs), language_id.train(docs))
    return found.select("doc_id", "lang", "probability", "text_lang", "rejected")


@query("page_language_id")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with the model learned from the documents: markup, address and host speak with the text."""
    model = language_id.train(documents(spark, sf_dir))
    return language_id.identify(language_id.page_rows(table(spark, sf_dir, "pages")), model)


@query("op1_learned_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return learned_ann.search(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)


#: Unsigned CRC-32 of ``(table).(column)`` as decimal text, for the ids of one table: table ``crc`` with id, crc.
CRC_SQL = r"""
crc_bits AS (
    SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_run AS (
    SELECT DISTINCT {column}::BIGINT AS id, {column}::VARCHAR AS s, 0 AS place, 4294967295::BIGINT AS c FROM {table} WHERE {column} IS NOT NULL
    UNION ALL
    SELECT id, s, place + 1, xor(r.c >> 8, b.c) FROM crc_run r JOIN crc_bits b ON b.k = 8 AND b.i = xor(r.c & 255, ascii(substr(s, place + 1, 1))) WHERE place < length(s)
), crc AS (SELECT id, xor(c, 4294967295) AS crc FROM crc_run WHERE place = length(s))
"""


def _merkle_sql(lower: int = 8, upper: int = 3, fanout: int = 8) -> str:
    """Trees of at most ``lower`` and ``upper`` levels, one table per level."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(frame, ("doc_id", "source", "lang", "n_chars")), frame(text)]) + ")"
    parts = [
        CRC_SQL.format(table="documents", column="doc_id").strip(),
        f"""t AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN crc % 3 = 0
        THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
    FROM documents LEFT JOIN crc ON id = doc_id)""",
        """a0 AS (
    SELECT doc_id, lang, leaf, coalesce(tampered, leaf) AS fold, leaf AS d, '' AS proof,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM t)""",
    ]

    def level(before: str, now: str, names: str, group: str) -> None:
        runs = f"SELECT DISTINCT {group}, pos, n, d FROM {before}"
        parts.append(
            f"""{now}r AS (SELECT {group}, n, pos // {fanout} AS run, list(d ORDER BY pos) AS m FROM ({runs}) GROUP BY ALL)"""
        )
        i = f"(a.pos % {fanout})::INT"
        parts.append(
            f"""{now} AS (
    SELECT {names}, CASE WHEN a.n = 1 THEN a.d ELSE sha256(array_to_string(m, '')) END AS d,
           CASE WHEN a.n = 1 THEN fold ELSE sha256(array_to_string(m[1:{i}], '') || fold || array_to_string(m[{i} + 2:], '')) END AS fold,
           CASE WHEN a.n = 1 THEN proof ELSE proof || array_to_string(m[1:{i}], '') || array_to_string(m[{i} + 2:], '') END AS proof,
           a.pos // {fanout} AS pos, ((a.n + {fanout - 1}) // {fanout})::BIGINT AS n
    FROM {before} a JOIN {now}r r ON a.{group} IS NOT DISTINCT FROM r.{group} AND a.pos // {fanout} = r.run)"""
        )

    for k in range(lower):
        level(f"a{k}", f"a{k + 1}", "doc_id, a.lang, leaf", "lang")
    parts.append(
        f"""g AS (SELECT lang, any_value(d) AS d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{lower} GROUP BY lang),
b0 AS (SELECT doc_id, leaf, a.d AS subroot, a.d, fold, proof, g.pos, g.n, 0 AS top FROM a{lower} a JOIN g ON a.lang IS NOT DISTINCT FROM g.lang)"""
    )
    for k in range(upper):
        level(f"b{k}", f"b{k + 1}", "doc_id, leaf, subroot, a.top", "top")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM b{upper}"""


@query("op11_merkle_proofs", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs for all leaves, checked against leaves of which every third or so was tampered with."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, merkle.leaf_digest(*values[:4], ascii_lower(F.col("text"))))
    made = merkle.proofs(documents(spark, sf_dir), merkle.leaf_digest(*values), F.col("lang"), {"doc_id": F.col("doc_id")}, {"changed": changed})
    out = made.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


TRIE_SQL = (
    "WITH RECURSIVE "
    + CRC_SQL.format(table="conversations", column="conv_id").strip()
    + r""",
o AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT id AS conv_id, (crc % 9)::INT AS h, id - id % 5 AS base FROM crc
), k AS (SELECT c.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = c.base)) AS k FROM c
), r AS (
    SELECT k.conv_id, place + 1 AS depth, role, text FROM k JOIN o ON o.conv_id = k.base AND place < h
    UNION ALL SELECT k.conv_id, place - h + k + 1, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND place >= h
), p AS (
    SELECT conv_id, 0::BIGINT AS depth, '' AS p, NULL::VARCHAR AS q, 0::BIGINT AS bytes FROM c
    UNION ALL
    SELECT p.conv_id, r.depth, sha256(p.p || strlen(role) || ':' || role || text), p.p, strlen(text)::BIGINT FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1
), n AS (SELECT depth, p, any_value(q) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, p
), ch AS (SELECT depth - 1 AS depth, q AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), e AS (
    SELECT depth, p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY depth, p
), a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, p)
), s AS (
    SELECT p.depth, p.p, count(*) FILTER (a.n_children = 0) AS n_leaves, sum((a.n_convs - 1) * a.bytes)::BIGINT AS saved_tokens
    FROM a JOIN p ON p.conv_id = a.conv_id AND p.depth <= a.depth GROUP BY p.depth, p.p
)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM a JOIN s USING (depth, p) LEFT JOIN e USING (depth, p) LEFT JOIN n u ON u.depth = a.depth - 1 AND u.p = a.q
"""
)


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(*prefix_trie.grafted(turns, every=5, modulus=9))


def _secrets_sql(reach: int = secret_links.REACH) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for no, (name, pattern, least, holds) in enumerate(secret_links.KINDS):
        p = quoted(pattern)
        value = f"regexp_extract_all(text, {p}, 2)" if least else f"regexp_extract_all(text, {p})"
        keep = " AND ".join([f"length(v) >= {least}", *[f"regexp_matches(v, '{h}')" for h in holds]])
        parts.append(
            f"""SELECT rn, kind_no, kind, start, start + len AS stop FROM (
        SELECT rn, {no} AS kind_no, '{name}' AS kind, length(m) AS len, v,
               (sum(length(g) + length(m)) OVER (PARTITION BY rn ORDER BY i))::BIGINT - length(m) AS start
        FROM (SELECT rn, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
              FROM (SELECT rn, regexp_extract_all(text, {p}) AS ms, {value} AS vs, string_split_regex(text, {p}) AS gs FROM d WHERE regexp_matches(text, {p})))
    ) WHERE {keep}"""
        )
    n = len(secret_links.BASE)
    role = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in secret_links.ROLES.items())
    found = lambda r: f"EXISTS (FROM a q WHERE q.rn = p.rn AND q.role = '{r}' AND q.start >= p.start - {reach} AND q.start < p.stop + {reach})"
    rules = " OR ".join(f"(kind = '{k}' AND {' AND '.join(map(found, v))})" for k, v in secret_links.NEEDS.items())
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no)"
    unions = "\n    UNION ALL ".join(parts)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents
), m AS MATERIALIZED ({unions}
), a AS MATERIALIZED (
    SELECT *, CASE kind {role} END AS role FROM m p
    WHERE kind_no < {n} OR NOT EXISTS (FROM m b WHERE b.rn = p.rn AND b.kind_no < {n} AND b.start < p.stop AND b.stop > p.start)
), s AS (SELECT * FROM a p WHERE kind_no < {n} OR {rules}
), g AS (
    SELECT rn, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_links.BASE)},
           {line} FILTER (kind_no < {n}) AS base, {line} AS spans FROM s GROUP BY rn
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_links.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rn)"""


@query("op12_secret_links", _secrets_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_links.scan(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind_no"] < len(secret_links.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in secret_links.BASE]
    return out.select("doc_id", *counts, F.sha2(secret_links.listed(base), 256).alias("base_sha256"), secret_links.listed(F.col("spans")).alias("spans"))
