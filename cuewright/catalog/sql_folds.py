"""SQL twins of the greedy folds, as recursive queries that walk row by row."""

from __future__ import annotations

from cuewright import fixed_values as fv
from cuewright.catalog import sql_bits as sb
from cuewright.catalog.registry import ORACLES, SQL_VIEWS

# ---- chunks ------------------------------------------------------------------------------------
SQL_VIEWS["v_chunk_rows"] = f"""
  SELECT video_id, seg_idx, vi_start AS start, CASE WHEN vi_end <= vi_start THEN vi_start + greatest(duration, 0.5) ELSE vi_end END AS "end", {sb.seg_text()} AS text FROM v_disp
  UNION ALL
  SELECT video_id, line_idx, start_ms / 1000.0::DOUBLE, start_ms / 1000.0::DOUBLE + dur_ms / 1000.0::DOUBLE, {sb.strip('line')} FROM v_lines
"""
SQL_VIEWS["v_chunk_pos"] = """
  SELECT *, row_number() OVER w - 1 AS pos, sum(length(text) + 1) OVER w AS reach, count(*) OVER (PARTITION BY video_id) - 1 AS last
  FROM v_chunk_rows WHERE text <> '' WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)
"""
SQL_VIEWS["v_chunk_next"] = f"""
  SELECT a.video_id, a.pos, a.last, b.pos AS reached FROM (SELECT *, reach - length(text) - 1 + {fv.CHUNK_TARGET_CHARS + 1} AS need FROM v_chunk_pos) a
  ASOF LEFT JOIN v_chunk_pos b ON a.video_id = b.video_id AND b.reach >= a.need
"""
SQL_VIEWS["v_chunk_chain"] = """
  SELECT video_id, 0::BIGINT AS s, 0::BIGINT AS n, coalesce(reached, last) AS e, last FROM v_chunk_next WHERE pos = 0
  UNION ALL
  SELECT c.video_id, x.pos, c.e + 1, CASE WHEN x.reached IS NULL THEN x.last ELSE greatest(x.reached, c.e + 1) END, x.last
  FROM v_chunk_chain c JOIN v_chunk_next x ON x.video_id = c.video_id AND x.pos = greatest(c.s, c.e - 1) WHERE c.e < c.last
"""
SQL_VIEWS["v_chunks"] = f"""
  SELECT video_id, n AS chunk_pos, segment_start, segment_end, start, "end", '[' || {sb.fmt_time('start')} || '-' || {sb.fmt_time('"end"')} || '] ' || body AS text FROM (
    SELECT c.video_id, c.n, min(p.seg_idx) AS segment_start, max(p.seg_idx) AS segment_end, arg_min(p.start, p.pos) AS start, max(p."end") AS "end",
           string_agg(p.text, ' ' ORDER BY p.pos) AS body
    FROM v_chunk_chain c JOIN v_chunk_pos p ON p.video_id = c.video_id AND p.pos BETWEEN c.s AND c.e GROUP BY c.video_id, c.n)
"""
_CHUNKS = f"SELECT *, 'subtitles' AS source, '{fv.RAG_VERSION}' AS rag_version FROM v_chunks"
ORACLES["chunk_segments"] = _CHUNKS
ORACLES["scan_chunks"] = _CHUNKS
ORACLES["sink_chunks"] = _CHUNKS
ORACLES["stream_index"] = "SELECT video_id, chunk_pos, segment_start, segment_end, start, \"end\", text FROM v_chunks WHERE video_id LIKE 'd%'"
ORACLES["embed_chunks"] = """
  SELECT video_id, chunk_id AS chunk_pos, 'hashing' AS embedding_provider, 'tf-256' AS embedding_model, 256 AS dims, b AS place,
         round(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, chunk_id)), 6) AS weight FROM k_vectors
"""
ORACLES["incremental_index"] = """
  SELECT video_id, chunk_pos, start, "end", text, 256 AS dims, CASE WHEN substr(video_id, 2)::BIGINT % 3 = 0 THEN 'missing' END AS reason FROM v_chunks WHERE video_id LIKE 'd%'
"""

# ---- merged segments ---------------------------------------------------------------------------
SQL_VIEWS["v_merge_rows"] = """
  SELECT *, coalesce(nullif(tts, ''), nullif(vi, ''), text) AS spoken, coalesce(nullif(vi, ''), nullif(tts, ''), text) AS shown,
    abs(start - lag(start + duration) OVER (PARTITION BY video_id ORDER BY seg_idx)) <= 0.6 AS near
  FROM (SELECT video_id, line_idx AS seg_idx, line AS text, CASE WHEN line_idx % 3 = 0 THEN 'Dòng ' || line_idx END AS vi, CASE WHEN line_idx % 4 = 0 THEN 'dòng ' || line_idx END AS tts,
          start_ms / 1000.0::DOUBLE AS start, dur_ms / 1000.0::DOUBLE AS duration FROM v_lines)
"""
SQL_VIEWS["v_merge_walk"] = """
  SELECT video_id, seg_idx, seg_idx AS group_start, length(spoken) AS acc FROM v_merge_rows WHERE seg_idx = 0
  UNION ALL
  SELECT r.video_id, r.seg_idx, CASE WHEN r.near AND w.acc + length(r.spoken) <= 200 THEN w.group_start ELSE r.seg_idx END,
    CASE WHEN r.near AND w.acc + length(r.spoken) <= 200 THEN w.acc ELSE 0 END + length(r.spoken)
  FROM v_merge_walk w JOIN v_merge_rows r ON r.video_id = w.video_id AND r.seg_idx = w.seg_idx + 1
"""
ORACLES["merge_segments"] = f"""
  SELECT video_id, group_start, string_agg(seg_idx::VARCHAR, ',' ORDER BY seg_idx) AS source_indices, string_agg({sb.strip('shown')}, '|' ORDER BY seg_idx) AS source_texts,
    {sb.strip("string_agg(" + sb.strip("coalesce(tts, '')") + ", ' ' ORDER BY seg_idx)")} AS text_tts, round(min(start), 3) AS start,
    round(arg_max(start + duration, seg_idx) - min(start), 3) AS duration
  FROM v_merge_walk JOIN v_merge_rows USING (video_id, seg_idx) GROUP BY video_id, group_start
"""

# ---- voice sample ------------------------------------------------------------------------------
SQL_VIEWS["v_voice_rows"] = f"""
  SELECT video_id, seg_idx, start, duration, start + duration AS "end", {sb.strip("coalesce(nullif(text, ''), nullif(tts, ''), nullif(vi, ''), '')")} AS t FROM v_merge_rows
"""
SQL_VIEWS["v_voice_steps"] = """
  SELECT *, coalesce(max("end") OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_start) AS before_end, max("end") OVER (g ROWS UNBOUNDED PRECEDING) AS reached,
    coalesce(bool_or(t <> '') OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun
  FROM (SELECT a.video_id, a.seg_idx AS anchor, a.start AS first_start, b.* EXCLUDE (video_id) FROM v_voice_rows a JOIN v_voice_rows b
        ON b.video_id = a.video_id AND b.seg_idx BETWEEN a.seg_idx AND a.seg_idx + 7)
  WINDOW g AS (PARTITION BY video_id, anchor ORDER BY seg_idx)
"""
SQL_VIEWS["v_voice_found"] = """
  SELECT *, abs(reached - first_start - 7) + 2 * gaps AS score FROM (
    SELECT *, sum(CASE WHEN begun THEN greatest(0.0, start - greatest(before_end, first_start)) ELSE 0.0 END) OVER g AS gaps,
      bool_or((begun AND start - greatest(before_end, first_start) > 1.25) OR reached - first_start > 10) OVER g AS stopped,
      string_agg(nullif(t, ''), ' ') OVER g AS said
    FROM v_voice_steps WINDOW g AS (PARTITION BY video_id, anchor ORDER BY seg_idx ROWS UNBOUNDED PRECEDING))
  WHERE NOT stopped AND reached - first_start >= 3 AND length(regexp_replace(said, '[^\\p{L}]', '', 'g')) >= 24
"""
ORACLES["reference_window"] = """
  SELECT video_id, first_start AS start, reached - first_start AS duration, said AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score, anchor, seg_idx) AS r FROM v_voice_found) WHERE r = 1
  UNION ALL
  SELECT video_id, start, least(duration, 7.0), CASE WHEN duration > 7 THEN coalesce(nullif(regexp_replace(cut, ' [^ ]*$', ''), ''), cut) ELSE t END FROM (
    SELECT *, substr(t, 1, greatest(1, floor(length(t) * (7.0::DOUBLE / duration))::BIGINT)) AS cut, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS r
    FROM v_voice_rows WHERE duration >= 3 AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 24 AND video_id NOT IN (SELECT video_id FROM v_voice_found)) WHERE r = 1
"""

# ---- progress ----------------------------------------------------------------------------------
SQL_VIEWS["v_percent"] = """
  SELECT video_id, line_idx AS pos, greatest(0, least(99, trunc((start_ms + dur_ms) / 1000.0::DOUBLE * 100 / greatest(0.1, max((start_ms + dur_ms) / 1000.0::DOUBLE) OVER (PARTITION BY video_id)))::BIGINT)) AS percent FROM v_lines
"""
SQL_VIEWS["v_throttled"] = """
  SELECT video_id, pos, percent AS shown, true AS emitted FROM v_percent WHERE pos = 0 AND percent >= 1
  UNION ALL SELECT video_id, pos, -1::BIGINT, false FROM v_percent WHERE pos = 0 AND percent < 1
  UNION ALL
  SELECT p.video_id, p.pos, CASE WHEN p.percent >= t.shown + 2 THEN p.percent ELSE t.shown END, p.percent >= t.shown + 2
  FROM v_throttled t JOIN v_percent p ON p.video_id = t.video_id AND p.pos = t.pos + 1
"""
ORACLES["progress_throttle"] = "SELECT video_id, pos, shown AS percent FROM v_throttled WHERE emitted"
