"""SQL (DuckDB) for the results of the engine's queries on the synthetic tables, written from their definitions."""

from __future__ import annotations

DAY = 86_400_000_000
NOW = 1_782_864_000_000_000
#: Sums of the eight 32-bit parts of the hashes h of a group.
_LANES = " || ".join(f"',' || sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(8))

_BASE = f"""
messages AS (
  SELECT 'conv:' || conv_id AS session_id, conv_id, CAST(turn AS INTEGER) AS idx, role, text FROM conversations
), told AS (
  SELECT * FROM messages WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0
), sessions AS (
  SELECT session_id, conv_id, substr(min_by(text, idx), 1, 60) AS title, count(*) AS n_messages,
    sha256(string_agg(role || ':' || text, chr(10) ORDER BY idx)) AS content_hash,
    CASE WHEN conv_id % 10 = 9 THEN NULL ELSE 1735689600000000 + ((conv_id * 37) % 540) * {DAY} + ((conv_id * 7919) % 86400) * 1000000 END AS started_us
  FROM told GROUP BY session_id, conv_id
), bound AS (
  SELECT e.vec_id, d.source, d.text, e.label, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vec,
    CAST(substr(d.source, 4) AS BIGINT) AS src_no, CAST(substr(d.source, 4) AS BIGINT) * 10 + (e.vec_id // 20) % 10 AS sess_no
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
), embedded AS (
  SELECT 'note:' || substr(sha256(source || ':s' || sess_no || chr(10) || text), 1, 16) AS note_id, vec_id, source || ':s' || sess_no AS session_id, source, src_no, sess_no, text, label, vec,
    1735689600000000 + ((sess_no * 37) % 540) * {DAY} + ((sess_no * 7919) % 86400) * 1000000 AS created_us,
    CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'theme:' || label || '-s' || sess_no ELSE 'theme:' || label || '-' || (src_no % 8) END AS theme_id,
    ['idea', 'decision', 'question', 'problem', 'insight'][CAST(vec_id % 5 + 1 AS INTEGER)] AS kind
  FROM bound
), notes AS (
  SELECT *, sqrt(list_dot_product(vec, vec)) + 1e-9 AS norm FROM embedded QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY vec_id) = 1
), rollup_ AS (
  SELECT theme_id, count(DISTINCT session_id) AS session_count, count(DISTINCT source) AS source_count, min(created_us) AS first_us, max(created_us) AS last_us,
    count(*) AS n_notes, (max(created_us) - min(created_us)) // {DAY} AS span_days, list_sort(list(note_id)) AS note_ids,
    sha256(count(*) || {_LANES}) AS content_hash, min_by(text, note_id) AS first_text
  FROM (SELECT *, sha256(note_id || ':' || text) AS h FROM notes WHERE theme_id IS NOT NULL) GROUP BY theme_id
), labelled AS (
  SELECT *, CASE WHEN length(first_text) > 40 THEN regexp_replace(regexp_replace(substr(first_text, 1, 40), ' [^ ]*$', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE first_text END AS label FROM rollup_
), themes AS (
  SELECT * EXCLUDE (v), CASE WHEN session_count < 2 OR span_days < 14 THEN 'unknown' WHEN v = 'open' AND last_us < {NOW - 60 * DAY} THEN 'dormant' ELSE v END AS status
  FROM (SELECT *, CASE WHEN theme_id LIKE 'theme:3-%' THEN 'resolved' ELSE 'open' END AS v FROM labelled)
), muted AS (
  SELECT DISTINCT lower(trim(label)) AS label_lc FROM labelled WHERE theme_id LIKE '%-5'
), open_ AS (
  SELECT *, session_count * (span_days + 1) AS score FROM themes WHERE status IN ('open', 'dormant') AND lower(trim(label)) NOT IN (SELECT label_lc FROM muted)
), pairs AS (
  SELECT a.note_id AS from_note, b.note_id AS to_note, a.theme_id AS from_theme, b.theme_id AS to_theme,
    list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS sim, CAST(abs(floor((a.created_us - b.created_us) / {float(DAY)})) AS BIGINT) AS gap_days, a.source <> b.source AS crosses
  FROM notes a JOIN notes b ON a.note_id < b.note_id AND a.theme_id IS DISTINCT FROM b.theme_id
), all_links AS (
  SELECT 'link:' || substr(sha256(from_note || '|' || to_note), 1, 16) AS link_id, from_note, to_note, from_theme, to_theme,
    round(sim * (1.0 + 1.0 * least(gap_days / 90.0::DOUBLE, 1.0::DOUBLE) + 0.5 * crosses::INTEGER::DOUBLE), 4) AS weight, gap_days
  FROM pairs WHERE sim >= 0.3
), links AS (
  SELECT *, CASE WHEN regexp_matches(link_id, '[0-3]$') THEN 'explained: ' || to_note END AS why FROM all_links ORDER BY weight DESC, from_note, to_note LIMIT 200
), told_links AS (
  SELECT l.*, a.text AS from_text, a.source AS from_source, a.session_id AS from_session, a.created_us AS from_us, b.text AS to_text, b.source AS to_source, b.session_id AS to_session, b.created_us AS to_us
  FROM links l JOIN notes a ON a.note_id = l.from_note JOIN notes b ON b.note_id = l.to_note
), q0 AS (
  SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 0
), near AS (
  SELECT note_id, round(list_dot_product(vec, q) / (norm * (sqrt(list_dot_product(q, q)) + 1e-9)), 6) AS score FROM notes, q0
), hot AS (
  SELECT * FROM (SELECT * FROM near ORDER BY score DESC, note_id LIMIT 25) WHERE score > 0.15
), top50 AS (
  SELECT note_id FROM near ORDER BY score DESC, note_id LIMIT 50
), member AS (
  SELECT theme_id, unnest(note_ids) AS note_id, generate_subscripts(note_ids, 1) AS pos FROM themes
), shown_note AS (
  SELECT *, source || ' · ' || strftime(make_timestamp(created_us), '%Y-%m-%d') || ' · session ' || session_id AS src FROM notes
), hit_themes AS (
  SELECT t.theme_id AS ref, t.label AS title, min_by(n.text, m.pos) AS summary, count(*) || ' of your prior notes match — e.g. “' || min_by(n.text, m.pos) || '”; thread status: ' || t.status AS why,
    round(sum(h.score), 6) AS score, t.status, strftime(make_timestamp(t.first_us), '%Y-%m-%d') || '→' || strftime(make_timestamp(t.last_us), '%Y-%m-%d') AS date_range,
    list_sort(list(DISTINCT n.src)) AS sources, list(m.note_id ORDER BY m.pos) AS cites
  FROM member m JOIN hot h ON h.note_id = m.note_id JOIN shown_note n ON n.note_id = m.note_id JOIN themes t ON t.theme_id = m.theme_id
  GROUP BY t.theme_id, t.label, t.status, t.first_us, t.last_us
), hit_bridges AS (
  SELECT l.link_id AS ref, substr(l.from_text, 1, 60) || ' ↔ ' || substr(l.to_text, 1, 60) AS title, l.to_text AS summary,
    coalesce(l.why, 'bridge across ' || CASE WHEN l.from_source = l.to_source THEN l.from_source ELSE least(l.from_source, l.to_source) || ' ↔ ' || greatest(l.from_source, l.to_source) END
      || CASE WHEN l.gap_days >= 60 THEN ' · ' || (l.gap_days // 30) || ' months apart' ELSE '' END) AS why,
    round(l.weight + greatest(coalesce(h1.score, 0), coalesce(h2.score, 0)), 6) AS score, [a.src, b.src] AS sources, [l.from_note, l.to_note] AS cites
  FROM told_links l LEFT JOIN hot h1 ON h1.note_id = l.from_note LEFT JOIN hot h2 ON h2.note_id = l.to_note
    JOIN shown_note a ON a.note_id = l.from_note JOIN shown_note b ON b.note_id = l.to_note
  WHERE h1.note_id IS NOT NULL OR h2.note_id IS NOT NULL
), best_themes AS (
  SELECT * FROM hit_themes ORDER BY score DESC, ref LIMIT 4
), cited AS (
  SELECT DISTINCT unnest(cites) AS note_id FROM (SELECT cites FROM best_themes UNION ALL SELECT cites FROM hit_bridges)
), hit_notes AS (
  SELECT h.note_id AS ref, substr(n.text, 1, 70) AS title, n.text AS summary, 'direct match (' || n.kind || ')' AS why, round(h.score * 0.8, 6) AS score, [n.src] AS sources, [h.note_id] AS cites
  FROM hot h JOIN shown_note n ON n.note_id = h.note_id WHERE h.note_id NOT IN (SELECT note_id FROM cited)
  QUALIFY row_number() OVER (ORDER BY h.score DESC, h.note_id) <= 7 - (SELECT count(*) FROM best_themes) - (SELECT count(*) FROM hit_bridges)
), hits AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, branch, ref) AS k, count(*) OVER () AS n FROM (
    SELECT 0 AS branch, 'theme' AS kind, ref, title, summary, why, score, status, sources, cites FROM best_themes
    UNION ALL SELECT 1, 'connection', ref, title, summary, why, score, NULL, sources, cites FROM hit_bridges
    UNION ALL SELECT 2, 'note', ref, title, summary, why, score, NULL, sources, cites FROM hit_notes)
), fused AS (
  SELECT CAST(least(k, 5) AS INTEGER) AS rank, * FROM (SELECT *, n > 5 AND coalesce(min(CASE WHEN kind = 'connection' THEN k END) OVER (), 0) > 5 AS swap, min(CASE WHEN kind = 'connection' THEN k END) OVER () AS bridge FROM hits)
  WHERE (k <= 5 AND NOT (swap AND k = 5)) OR (swap AND k = bridge)
), proposals AS (
  SELECT 'prop:' || d.doc_id AS proposal_id, d.doc_id, substr(d.text, 1, 40) AS title,
    CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'kept' ELSE 'dismissed' END AS outcome,
    CASE WHEN d.doc_id % 6 = 5 THEN NULL ELSE CAST(d.doc_id % 6 AS INTEGER) END AS feasibility,
    CASE WHEN d.doc_id % 2 = 0 THEN 'paraphrase' ELSE 'no valid cites' END AS reject_reason
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), log AS (
  SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {7 * DAY} + 1 AS digest_id, event_id, epoch_us(ts) AS ts_us,
    'theme:' || (user_id % 10) || '-' || (event_id % 8) AS theme_ref, CASE WHEN event_id % 2 = 0 THEN 'nudge' ELSE 'connection' END AS kind,
    CASE WHEN event_id % 3 = 0 AND event_id % 8 IN (0, 3, 6) THEN 'dismissed' WHEN event_id % 3 = 1 THEN 'kept' ELSE 'shown' END AS outcome
  FROM events
), dismissed AS (
  SELECT theme_ref, count(*) AS n_dismissed FROM log WHERE outcome = 'dismissed' GROUP BY theme_ref HAVING count(*) >= 2
), blocked AS (
  SELECT theme_ref FROM dismissed UNION SELECT theme_id FROM labelled WHERE lower(trim(label)) IN (SELECT label_lc FROM muted)
), recent AS (
  SELECT DISTINCT theme_ref FROM log WHERE kind = 'nudge' AND digest_id IN (SELECT DISTINCT digest_id FROM log ORDER BY digest_id DESC LIMIT 2)
), digest_c AS (
  SELECT 'connection' AS kind, link_id AS ref, from_theme AS theme_ref, substr(from_text, 1, 120) || ' ↔ ' || substr(to_text, 1, 120) AS snapshot, row_number() OVER (ORDER BY weight DESC, from_note, to_note) AS k
  FROM (SELECT * FROM told_links ORDER BY weight DESC, from_note, to_note LIMIT 100)
  WHERE link_id NOT IN (SELECT link_id FROM links ORDER BY weight DESC, from_note, to_note LIMIT 2)
    AND ((from_theme IS NOT NULL AND from_theme NOT IN (SELECT theme_ref FROM blocked)) OR (to_theme IS NOT NULL AND to_theme NOT IN (SELECT theme_ref FROM blocked)))
  QUALIFY k <= 2
), digest_n AS (
  SELECT 'nudge' AS kind, theme_id AS ref, theme_id AS theme_ref, substr(label, 1, 200) AS snapshot, row_number() OVER (ORDER BY score DESC, session_count DESC, theme_id) AS k
  FROM open_ WHERE status = 'open' AND theme_id NOT IN (SELECT theme_ref FROM blocked) AND theme_id NOT IN (SELECT theme_ref FROM recent) QUALIFY k <= 2
), ranked AS (
  SELECT proposal_id, title, coalesce(CAST(feasibility AS DOUBLE), 2.5) AS rank_score, doc_id FROM proposals WHERE outcome = 'pending'
), commits AS (
  SELECT item_id AS pos, 'c' || item_id AS sha, text AS message FROM benchmark ORDER BY item_id LIMIT 300
), fresh AS (
  SELECT CAST(row_number() OVER (ORDER BY session_count DESC, theme_id) AS INTEGER) AS n, theme_id, label FROM themes WHERE session_count >= 2 QUALIFY n <= 3
), digests AS (
  SELECT digest_id, max(ts_us) AS created_us, count(*) AS item_count FROM log GROUP BY digest_id UNION ALL SELECT max(digest_id) + 1, {NOW - 1}, 0 FROM log
  UNION ALL SELECT max(digest_id) + 2, {NOW}, (SELECT count(*) FROM fresh) FROM log
), rated AS (
  SELECT doc_id, proposal_id, title, feasibility, CASE WHEN doc_id % 3 = 0 THEN 'dismissed' WHEN doc_id % 2 = 0 THEN 'kept' ELSE outcome END AS outcome, CASE WHEN outcome = 'rejected' THEN reject_reason END AS reject_reason,
    CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'good' END AS rating_note, CASE WHEN doc_id % 3 = 0 THEN 20 WHEN doc_id % 2 = 0 THEN 10 END::BIGINT AS rated_us, CASE WHEN doc_id % 3 = 0 THEN 'digest' WHEN doc_id % 2 = 0 THEN 'cli' END AS rated_via
  FROM proposals
), health AS (
  SELECT 'p' || n_regionkey AS provider, 'm' || n_nationkey AS model, n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey * 13 % 7 + 1 END::BIGINT AS calls,
    CASE WHEN n_nationkey % 7 = 3 THEN 9e12 WHEN n_nationkey % 2 = 0 THEN 0.0 ELSE {NOW // 1_000_000 + 60}.0 END::DOUBLE AS cooldown FROM nation
), excerpts AS (
  SELECT n.*, substr(regexp_replace(m.text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 1, 400) AS raw FROM notes n LEFT JOIN messages m ON m.conv_id = n.vec_id AND m.idx = 1
), data AS (
  SELECT theme_id, label, status, session_count, source_count, n_notes, strftime(make_timestamp(first_us), '%Y-%m-%d') AS first_day, strftime(make_timestamp(last_us), '%Y-%m-%d') AS last_day, lower(label) IN (SELECT label_lc FROM muted) AS is_muted FROM themes
), storage AS (
  SELECT 'messages' AS table_name, 'raw' AS data_class, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM messages
  UNION ALL SELECT 'notes', 'derived', count(*), coalesce(sum(length(text)), 0)::BIGINT FROM notes UNION ALL SELECT 'themes', 'derived', count(*), coalesce(sum(length(label)), 0)::BIGINT FROM themes
  UNION ALL SELECT 'proposals', 'judgment', count(*), coalesce(sum(length(title)), 0)::BIGINT FROM proposals
)
"""

_STRIPPED = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_READ_STRIPPED = f""", x AS (SELECT session_id, idx, role, {_STRIPPED.format("text")} AS text FROM told)
SELECT session_id, count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY idx)) AS content_sha FROM x GROUP BY session_id"""
_READ_BACK = "SELECT session_id, n_messages, content_hash AS content_sha FROM sessions"
_LINE = "('[' || note_id || '] (' || kind || ', ' || source || ') ' || text || CASE WHEN length(raw) > 0 THEN chr(10) || '    raw: ' || raw ELSE '' END)"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}')), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', 'your'))"


def _git(commits: str) -> str:
    """``fx``: the hits of ``fused`` with what they share with the table ``commits``."""
    return f""", fw AS (SELECT ref, unnest({_WORDS.format("title || ' ' || summary")}) AS w FROM fused), cw AS (SELECT pos, unnest({_WORDS.format("message")}) AS w FROM {commits})
, og AS (SELECT ref, pos FROM fw JOIN cw USING (w) GROUP BY ref, pos HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, pos) = 1)
, fg AS (SELECT f.*, 'possibly implemented in ' || c.sha || ' — “' || c.message || '”' AS git_ref FROM fused f LEFT JOIN og ON og.ref = f.ref LEFT JOIN {commits} c ON c.pos = og.pos)
, fx AS (SELECT * EXCLUDE (why), CASE WHEN status = 'open' AND git_ref IS NOT NULL THEN why || ' · a local commit may have addressed this' ELSE why END AS why FROM fg)
"""


#: All commits; ``commits`` are the newest 300.
_EVERY_COMMIT = ", every_commit AS (SELECT item_id AS pos, 'c' || item_id AS sha, text AS message FROM benchmark)"
_HEALTH = """, calls AS (
  SELECT 'p' || (user_id % 5) AS provider, event_type AS model, epoch_us(ts) / 1e6 AS moment, CASE WHEN event_id % 7 < 2 THEN 'limited' WHEN event_id % 7 = 2 THEN 'server' ELSE 'ok' END AS outcome,
    CASE WHEN event_id % 21 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS told_wait, length(props) AS sent, event_id % 9 AS received FROM events
), total AS (
  SELECT provider, model, max(moment) AS last_call, max(moment) FILTER (WHERE outcome = 'ok') AS last_success, count(*) FILTER (WHERE outcome = 'ok') AS calls,
    CAST(coalesce(sum(sent) FILTER (WHERE outcome = 'ok'), 0) AS BIGINT) AS sent_bytes, CAST(coalesce(sum(received) FILTER (WHERE outcome = 'ok'), 0) AS BIGINT) AS recv_bytes FROM calls GROUP BY ALL
), since AS (
  SELECT provider, model, count(*) AS consecutive, max(moment) AS limited_at, arg_max(coalesce(told_wait, -1), moment) AS told_wait FROM calls JOIN total USING (provider, model)
  WHERE outcome = 'limited' AND (last_success IS NULL OR moment > last_success) GROUP BY ALL
), placed AS (
  SELECT *, count(*) FILTER (WHERE outcome = 'limited') OVER (PARTITION BY provider, model ORDER BY moment, CASE outcome WHEN 'limited' THEN 0 WHEN 'ok' THEN 2 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS limits FROM calls
), runs AS (SELECT provider, model, limits, count(*) FILTER (WHERE outcome = 'ok') AS gains FROM placed WHERE limits > 0 GROUP BY ALL),
rates AS (
  SELECT provider, model, list_reduce(list_prepend(0.5::DOUBLE, list(CAST(gains AS DOUBLE) ORDER BY limits)), lambda r, n: least(2.0::DOUBLE, greatest(r / 2, 1::DOUBLE / 120) + n * 0.05::DOUBLE)) AS est_rate FROM runs GROUP BY ALL
), healthy AS (
  SELECT t.provider, t.model, coalesce(limited_at + least(86400, CASE WHEN s.told_wait >= 0 THEN s.told_wait ELSE ([5, 30, 120, 900, 3600, 21600, 86400])[least(consecutive - 1, 6) + 1] END), 0) AS cooldown_until,
    CAST(least(greatest(coalesce(consecutive, 0) - 1, 0), 6) AS INTEGER) AS rung, CAST(coalesce(consecutive, 0) AS INTEGER) AS consecutive, est_rate, coalesce(last_success, 0) AS last_success, last_call, calls, sent_bytes, recv_bytes
  FROM total t LEFT JOIN since s USING (provider, model) LEFT JOIN rates USING (provider, model)
)"""

_TAILS = {
    "session_rollup": "SELECT session_id, title, started_us, n_messages FROM sessions",
    "session_content_hash": "SELECT session_id, content_hash FROM sessions",
    "upsert_classify": "SELECT session_id, CASE WHEN conv_id % 7 = 3 THEN 'new' WHEN conv_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM sessions",
    "upsert_apply": "SELECT session_id, CASE WHEN conv_id % 5 = 0 THEN sha256(content_hash || 'edited') ELSE content_hash END AS content_hash FROM sessions",
    "pending_distill": "SELECT session_id, started_us FROM sessions WHERE conv_id % 3 <> 0 OR conv_id % 15 = 0 ORDER BY started_us DESC NULLS LAST, session_id LIMIT 50",
    "insert_if_absent": "SELECT proposal_id, CASE WHEN doc_id % 2 = 0 THEN outcome ELSE 'pending' END AS outcome FROM proposals",
    "latest_judgment": "SELECT theme_ref, event_id, outcome FROM log QUALIFY row_number() OVER (PARTITION BY theme_ref ORDER BY ts_us DESC, event_id DESC) = 1",
    "strip_wrappers": "SELECT session_id, idx, sha256(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS clean_sha FROM messages",
    "scrub_secrets": """SELECT session_id, idx, text || ' ' || CASE WHEN (conv_id + idx) % 15 < 11 THEN '[REDACTED]'
  ELSE ['sk-abcdefghij012345678', 'ghx_abcdefghij0123456789', 'AKIAABCDEFGHIJKLMNO', 'xoxq-123456789-a'][CAST((conv_id + idx) % 15 - 10 AS INTEGER)] END || ' end' AS clean FROM messages""",
    "meta_message": "SELECT session_id, idx, idx % 4 < 2 AS is_meta FROM messages",
    "render_prompt": """, s AS (SELECT session_id, idx, role, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM messages)
, l AS (SELECT session_id, idx, 'msg:' || idx || ' [' || role || '] ' || CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || ' […]' ELSE t END AS line FROM s WHERE length(t) > 0)
, r AS (SELECT *, sum(length(line)) OVER (PARTITION BY session_id ORDER BY idx) AS used FROM l)
, g AS (SELECT session_id, string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE used <= 16000) || CASE WHEN max(used) > 16000 THEN chr(10) || '[… truncated]' ELSE '' END AS prompt FROM r GROUP BY session_id)
SELECT session_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha FROM g""",
    "note_ids": "SELECT vec_id, note_id FROM embedded",
    "note_dedup": "SELECT note_id, min(vec_id) AS vec_id FROM embedded GROUP BY note_id",
    "show_source": """, p AS (SELECT conv_id, session_id, title, CASE conv_id % 7 WHEN 6 THEN NULL WHEN 5 THEN 99 ELSE conv_id % 3 END AS i FROM sessions)
SELECT 'note:' || p.conv_id AS note_id, p.session_id, p.title, substr(regexp_replace(m.text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 1, 400) AS excerpt
FROM p LEFT JOIN messages m ON m.conv_id = p.conv_id AND m.idx = p.i""",
    "ground_context": f""", r AS (SELECT theme_id, length({_LINE}) AS n, sum(length({_LINE})) OVER (PARTITION BY theme_id ORDER BY note_id) AS used FROM excerpts WHERE theme_id IS NOT NULL)
SELECT theme_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars FROM r WHERE used <= 6000 GROUP BY theme_id""",
    "normalize_cites": "SELECT theme_id, CASE WHEN len(note_ids) > 1 THEN note_ids[1] || ',' || note_ids[2] ELSE note_ids[1] END AS cites FROM themes",
    "fallback_label": "SELECT theme_id, label FROM themes",
    "truncate_text": "SELECT note_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS short FROM notes",
    "hash_embed": """, j AS (SELECT item_id, j, CAST('0x' || substr(sha256(j || ':' || text), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x FROM benchmark, (SELECT unnest(range(384))::INTEGER AS j))
SELECT item_id, j, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM j""",
    "knn_topk": "SELECT note_id, score FROM near ORDER BY score DESC, note_id LIMIT 25",
    "min_cluster_size": "SELECT label, CAST(greatest(2, least(8, (count(*) * 20) // 400)) AS INTEGER) AS size FROM notes GROUP BY label",
    "theme_rollup": "SELECT theme_id, session_count, source_count, first_us, last_us, n_notes, span_days FROM rollup_",
    "theme_content_hash": "SELECT theme_id, content_hash FROM rollup_",
    "theme_status": "SELECT theme_id, status FROM themes",
    "unfinished": "SELECT theme_id, label, session_count, span_days, score FROM open_ WHERE status = 'open'",
    "unfinished_dormant": "SELECT theme_id, status, score FROM open_",
    "list_themes": "SELECT theme_id, session_count FROM themes ORDER BY session_count DESC, theme_id LIMIT 50",
    "links_topk": "SELECT link_id, from_note, to_note, weight, gap_days FROM links",
    "refresh_links": "SELECT link_id, from_note, to_note, weight, gap_days FROM links",
    "refresh_themes": "SELECT theme_id, session_count, source_count, first_us, last_us, n_notes, content_hash FROM rollup_",
    "links_all": "SELECT from_note AS note_id, count(*) AS n_links FROM all_links GROUP BY from_note",
    "connections": "SELECT link_id, from_note, to_note, from_text, to_text, from_source, to_source, weight, gap_days, why FROM told_links ORDER BY weight DESC, from_note, to_note LIMIT 20",
    "theme_pairs": """SELECT least(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_a, greatest(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_b,
  count(*) AS n_links, round(max(weight), 3) AS max_weight, arg_max(link_id, (weight, from_note, to_note)) AS sample_link FROM links GROUP BY ALL""",
    "pair_edges": """SELECT least(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_a, greatest(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_b, count(*) AS n_links
FROM links GROUP BY ALL ORDER BY n_links DESC, theme_a, theme_b LIMIT 15""",
    "bridges": """SELECT l.link_id, round(l.weight, 3) AS weight, l.gap_days, substr(l.from_text, 1, 220) AS from_text, substr(l.to_text, 1, 220) AS to_text, l.from_source, l.to_source, a.label AS from_theme_label, b.label AS to_theme_label
FROM (SELECT * FROM told_links ORDER BY weight DESC, from_note, to_note LIMIT 20) l LEFT JOIN themes a ON a.theme_id = l.from_theme LEFT JOIN themes b ON b.theme_id = l.to_theme""",
    "recall_themes": "SELECT ref, title, why, score, status, date_range, array_to_string(sources, '|') AS sources, array_to_string(cites, '|') AS cites FROM hit_themes",
    "recall_bridges": "SELECT ref, title, why, score, array_to_string(sources, '|') AS sources FROM hit_bridges",
    "recall": "SELECT rank, kind, ref, score, why FROM fused",
    "recall_commits": _EVERY_COMMIT + _git("every_commit") + "SELECT rank, ref, why, git_ref FROM fx",
    "recall_handoff": _git("commits").rstrip() + """, b AS (SELECT string_agg(rank || '. ' || title || CASE WHEN status IS NULL THEN '' ELSE ' [' || status || ']' END || ' — ' || summary || chr(10) || '   why: ' || why || coalesce(chr(10) || '   ' || git_ref, '') || chr(10) || '   sources: ' || array_to_string(sources, '; '), chr(10) ORDER BY rank) AS t FROM fx)
, c AS (SELECT string_agg(x, ', ' ORDER BY x) AS t FROM (SELECT DISTINCT unnest(cites) AS x FROM fx))
, h AS (SELECT coalesce('Relevant prior context (query: “vector 0”):' || chr(10) || chr(10) || b.t || chr(10) || chr(10) || 'Treat this as prior context, not ground truth — verify against the current code.' || chr(10) || 'cites: ' || c.t, 'no prior context found for “vector 0”') AS handoff FROM b, c)
SELECT sha256(handoff) AS handoff_sha, length(handoff) AS n_chars FROM h""",
    "ask": """, q1 AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 1)
, n1 AS (SELECT note_id FROM notes, q1 ORDER BY round(list_dot_product(vec, q) / (norm * (sqrt(list_dot_product(q, q)) + 1e-9)), 6) DESC, note_id LIMIT 1)
SELECT t.theme_id, t.label, t.status, t.session_count FROM n1 JOIN member m ON m.note_id = n1.note_id JOIN themes t ON t.theme_id = m.theme_id ORDER BY t.theme_id LIMIT 1""",
    "find_connections": """SELECT link_id, substr(from_text, 1, 400) AS from_text, substr(to_text, 1, 400) AS to_text, round(weight, 3) AS weight FROM told_links
WHERE from_note IN (SELECT note_id FROM top50) OR to_note IN (SELECT note_id FROM top50) ORDER BY told_links.weight DESC, from_note, to_note LIMIT 10""",
    "topic_themes": """SELECT t.theme_id, t.label, t.status, t.session_count, count(*) AS n_hits FROM member m JOIN top50 h ON h.note_id = m.note_id JOIN themes t ON t.theme_id = m.theme_id
WHERE lower(trim(t.label)) NOT IN (SELECT label_lc FROM muted) GROUP BY ALL ORDER BY n_hits DESC, t.theme_id LIMIT 10""",
    "label_search": "SELECT theme_id, label, status, session_count FROM themes WHERE contains(lower(label), 'the') OR contains(lower(label), 'an') OR contains(lower(label), 'of') ORDER BY theme_id LIMIT 10",
    "commit_xref": f""", h AS (SELECT note_id AS ref, unnest({_WORDS.format("text")}) AS w FROM notes), c AS (SELECT pos, unnest({_WORDS.format("message")}) AS w FROM commits)
, o AS (SELECT ref, pos, count(*) AS overlap FROM h JOIN c USING (w) GROUP BY ref, pos HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, pos) = 1)
SELECT ref, pos, overlap, substr(b.text, 1, 60) AS message FROM o JOIN benchmark b ON b.item_id = o.pos""",
    "hit_rate": "SELECT count(*) AS total, count_if(outcome = 'kept')::BIGINT AS kept, count_if(outcome = 'dismissed')::BIGINT AS dismissed, ((100 * count_if(outcome = 'kept')) // nullif(count_if(outcome IN ('kept', 'dismissed')), 0))::BIGINT AS hit_rate FROM proposals",
    "rejection_mix": "SELECT reject_reason, count(*) AS n FROM proposals WHERE outcome = 'rejected' GROUP BY reject_reason",
    "proposals_ranked": "SELECT proposal_id, title, rank_score FROM ranked ORDER BY rank_score DESC, doc_id LIMIT 20",
    "proposal_candidates": """, c AS (
  SELECT 0 AS branch, 'connection' AS kind, link_id AS ref, sha256(least(sha256(from_note || ':' || from_text), sha256(to_note || ':' || to_text)) || chr(10) || greatest(sha256(from_note || ':' || from_text), sha256(to_note || ':' || to_text))) AS source_hash, weight AS score
  FROM (SELECT * FROM told_links ORDER BY weight DESC, from_note, to_note LIMIT 120)
  UNION ALL SELECT 1, 'thread', theme_id, content_hash, score::DOUBLE FROM open_ WHERE status = 'open')
SELECT kind, ref, source_hash, score FROM c WHERE source_hash NOT IN (SELECT content_hash FROM themes WHERE session_count % 3 = 0) ORDER BY branch, score DESC, ref LIMIT 60""",
    "novelty_gate": """, p AS (SELECT 'prop:' || vec_id AS proposal_id, theme_id, vec, norm, note_id FROM notes WHERE theme_id IS NOT NULL)
, few AS (SELECT * FROM notes WHERE theme_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY note_id) <= 10)
, s AS (SELECT p.proposal_id, round(max(list_dot_product(p.vec, n.vec) / (p.norm * n.norm)), 6) AS novelty_sim FROM p LEFT JOIN few n ON n.theme_id = p.theme_id AND (n.note_id <> p.note_id OR p.note_id < 'note:4') GROUP BY p.proposal_id)
SELECT proposal_id, novelty_sim, coalesce(novelty_sim > 0.9, false) AS is_paraphrase FROM s""",
    "dismissed_counts": "SELECT theme_ref, n_dismissed FROM dismissed",
    "recent_nudges": "SELECT theme_ref FROM recent",
    "digest_connections": "SELECT ref, theme_ref, snapshot FROM digest_c",
    "digest_nudges": "SELECT ref, snapshot FROM digest_n",
    "digest_items": """, i AS (SELECT 0 AS branch, * FROM digest_c UNION ALL SELECT 1, * FROM digest_n
  UNION ALL SELECT 2, 'proposal', proposal_id, NULL, substr(title, 1, 200), 1 FROM (SELECT * FROM ranked ORDER BY rank_score DESC, doc_id LIMIT 1))
SELECT CAST(row_number() OVER (ORDER BY branch, k) AS INTEGER) AS n, kind, ref, theme_ref, snapshot, 'shown' AS outcome FROM i""",
    "digest_due": f"SELECT max(ts_us) AS last_us, coalesce({NOW} - max(ts_us) >= {7 * DAY}, true) AS is_due FROM log",
    "timeline_weeks": "SELECT strftime(make_timestamp(created_us), '%G-W%V') AS week, source, count(*) AS n_notes FROM notes GROUP BY ALL",
    "timeline_arcs": "SELECT theme_id, label, status, first_us, last_us, session_count FROM themes WHERE status IN ('open', 'dormant')",
    "overview": """SELECT 'sessions' AS metric, count(*) AS value FROM sessions UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'themes', count(*) FROM themes
UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'proposals', count(*) FROM proposals
UNION ALL SELECT 'hit_rate', ((100 * count_if(outcome = 'kept')) // nullif(count_if(outcome IN ('kept', 'dismissed')), 0))::BIGINT FROM proposals
UNION ALL SELECT 'status:' || status, count(*) FROM themes GROUP BY status UNION ALL SELECT 'source:' || source, count(DISTINCT session_id) FROM notes GROUP BY source""",
    "orphan_embeddings": "SELECT note_id FROM notes WHERE vec_id % 13 = 0",
    "dangling_links": "SELECT link_id, from_note, to_note FROM links WHERE from_note IN (SELECT note_id FROM notes WHERE vec_id % 13 = 0) OR to_note IN (SELECT note_id FROM notes WHERE vec_id % 13 = 0)",
    "pipeline_drift": "SELECT count(DISTINCT session_id) AS n_sessions FROM notes WHERE vec_id % 9 = 0",
    "storage_report": "SELECT * FROM storage",
    "refresh_stats": """, d AS (SELECT count(*) AS todo, count_if(conv_id % 10 > 1)::BIGINT AS ok, count_if(conv_id % 10 = 1)::BIGINT AS zero_note, count_if(conv_id % 10 = 0)::BIGINT AS failed, 0::BIGINT AS cold FROM sessions)
, a AS (SELECT count_if(session_count > 1)::BIGINT AS label_cached, 0::BIGINT AS label_llm, count_if(session_count <= 1)::BIGINT AS label_fallback FROM themes)
, s AS (SELECT 0::BIGINT AS status_ok, count_if(status <> 'unknown')::BIGINT AS status_heuristic, 0::BIGINT AS status_error, count_if(status = 'unknown')::BIGINT AS status_na FROM themes)
SELECT *, label_fallback > 0 OR status_heuristic > 0 AS degraded FROM d, a, s""",
    "jsonl_sessions": _READ_BACK,
    "log_sessions": _READ_BACK,
    "export_sessions": _READ_STRIPPED,
    "composer_bubbles": _READ_STRIPPED,
    "kv_tabs": _READ_STRIPPED,
    "kv_spellings": f""", x AS (SELECT conv_id, idx, role, {_STRIPPED.format("text")} AS text FROM told WHERE conv_id % 6 <> 5)
SELECT conv_id::VARCHAR AS native_id, 1760000000 + conv_id AS started_s, count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY idx)) AS content_sha FROM x GROUP BY conv_id""",
    "meta_sessions": """, x AS (SELECT session_id, conv_id, idx, role, CASE WHEN conv_id % 3 = 0 AND idx = 0 THEN '<system-reminder>' || repeat('z', 250) || '</system-reminder>You are a completeness critic. ' || text ELSE text END AS text FROM told
  WHERE NOT (conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM told WHERE idx = 0 AND role = 'user')))
SELECT session_id, count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY idx)) AS content_sha FROM x GROUP BY session_id""",
    "lacking_embeddings": "SELECT note_id FROM notes WHERE vec_id % 5 = 3",
    "embed_missing": """, j AS (SELECT note_id, j, CAST('0x' || substr(sha256(j || ':' || text), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE - 0.5::DOUBLE AS x FROM notes, (SELECT unnest(range(384))::INTEGER AS j) WHERE vec_id % 5 = 3)
, e AS (SELECT note_id, max(x) FILTER (WHERE j = 0) / sqrt(sum(x * x)) AS a, max(x) FILTER (WHERE j = 383) / sqrt(sum(x * x)) AS b FROM j GROUP BY note_id)
SELECT note_id, 384 AS dim, round(a::FLOAT::DOUBLE, 5) AS x0, round(b::FLOAT::DOUBLE, 5) AS x_last FROM e UNION ALL SELECT note_id, 1, 1.0::DOUBLE, 1.0::DOUBLE FROM notes WHERE vec_id % 5 <> 3""",
    "notes_version": "SELECT session_id, CASE WHEN sess_no % 4 = 0 THEN 2 ELSE 1 END AS pipeline_version, count(*) AS n, sum(length(text) + CASE WHEN sess_no % 4 = 0 THEN 4 ELSE 0 END)::BIGINT AS n_chars FROM notes GROUP BY ALL",
    "replace_user_themes": "SELECT 'u' || (length(theme_id) % 3) AS user_id, CASE WHEN length(theme_id) % 3 = 0 THEN 'new:' || theme_id ELSE theme_id END AS theme_id, session_count FROM themes WHERE length(theme_id) % 3 <> 1",
    "label_cache": """, p AS (SELECT theme_id, string_agg('- ' || text, chr(10) ORDER BY note_id) AS prompt FROM (SELECT * FROM notes WHERE theme_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY note_id) <= 40) GROUP BY theme_id)
, w AS (SELECT t.*, p.prompt, CASE WHEN session_count > 3 THEN 'cached' WHEN contains(length(prompt)::VARCHAR, '7') THEN 'fallback' ELSE 'llm' END AS way FROM themes t JOIN p USING (theme_id))
SELECT theme_id, CASE way WHEN 'cached' THEN 'cached ' || theme_id WHEN 'llm' THEN length(prompt) || ' characters' ELSE label END AS label, CASE way WHEN 'cached' THEN 's' WHEN 'llm' THEN substr(prompt, 1, 20) ELSE '' END AS summary, way FROM w""",
    "status_cache": f""", p AS (SELECT theme_id, length(string_agg(text, chr(10) ORDER BY note_id)) % 4 AS m FROM notes WHERE theme_id IS NOT NULL GROUP BY theme_id)
, v AS (SELECT theme_id, last_us < {NOW - 60 * DAY} AS stale, CASE WHEN session_count < 2 OR span_days < 14 THEN 'na' WHEN theme_id LIKE 'theme:3-%' OR m < 2 THEN 'ok' WHEN m = 3 THEN 'error' ELSE 'heuristic' END AS way,
  CASE WHEN session_count < 2 OR span_days < 14 THEN NULL WHEN theme_id LIKE 'theme:3-%' OR m = 0 THEN 'resolved' WHEN m = 1 THEN 'open' END AS verdict FROM rollup_ JOIN p USING (theme_id))
SELECT theme_id, CASE WHEN way IN ('na', 'error') THEN 'unknown' WHEN coalesce(verdict, 'open') = 'open' AND stale THEN 'dormant' ELSE coalesce(verdict, 'open') END AS status, verdict, way FROM v""",
    "link_reasons": "SELECT link_id, coalesce(why, length('A: ' || from_text || chr(10) || 'B: ' || to_text) || ' characters in common') AS why FROM told_links",
    "connections_of_theme": """, f AS (SELECT min(from_theme) AS x FROM links)
SELECT link_id, from_note, to_note, from_text, to_text, from_source, to_source, weight, gap_days, why FROM told_links, f WHERE from_theme = x OR to_theme = x ORDER BY weight DESC, from_note, to_note LIMIT 20""",
    "rate_proposals": "SELECT proposal_id, outcome, rating_note, rated_us, rated_via FROM rated",
    "mute_unmute": f"""SELECT label_lc FROM (SELECT label_lc FROM muted UNION SELECT lower({_STRIPPED.format("label")}) FROM labelled WHERE theme_id LIKE '%-2')
WHERE label_lc NOT IN (SELECT lower({_STRIPPED.format("label")}) FROM labelled WHERE theme_id LIKE 'theme:1-%')""",
    "digest_insert": "SELECT digest_id, created_us, item_count FROM digests",
    "digest_outcomes": "SELECT n, theme_id AS ref, CASE n WHEN 1 THEN 'kept' WHEN 2 THEN 'dismissed' ELSE 'shown' END AS outcome, CASE n WHEN 1 THEN 5 WHEN 2 THEN 7 END::BIGINT AS acted_us FROM fresh",
    "latest_digest": "SELECT digest_id, created_us, item_count FROM digests ORDER BY digest_id DESC LIMIT 1",
    "meta_and_health": """, h AS (SELECT provider || '/' || model AS key, cooldown::DECIMAL(20, 1)::VARCHAR || ',' || CASE WHEN k % 3 = 0 THEN '0.25' ELSE '-' END || ',' || (k % 4) || ',' || calls AS value FROM health)
SELECT key, value FROM h WHERE key NOT IN ('p0/m0', 'p1/m1', 'p9/m99') UNION ALL SELECT * FROM (VALUES ('p0/m0', '5.0,-,0,3'), ('p1/m1', '0.0,-,0,4'), ('p9/m99', '1.5,-,0,0'), ('a', '1'), ('b', '3'), ('c', '4'))""",
    "llm_traffic": "SELECT provider, model, calls, calls * 100 AS sent_bytes, calls * 7 AS recv_bytes FROM health WHERE calls > 0",
    "rebuild_derived": """SELECT 'notes' AS table_name, 0::BIGINT AS n_left, count(*) AS n_discarded FROM notes UNION ALL SELECT 'themes', 0, count(*) FROM rollup_ UNION ALL SELECT 'links', 0, count(*) FROM links
UNION ALL SELECT 'sessions', count(*), NULL FROM sessions UNION ALL SELECT 'proposals', count(*), NULL FROM proposals UNION ALL SELECT 'embed_dim', NULL, NULL""",
    "proposals_data": "SELECT proposal_id, title, feasibility, outcome, reject_reason, rated_via, rating_note FROM rated",
    "doctor_checks": """, n AS (SELECT * FROM notes WHERE vec_id % 13 <> 0), o AS (SELECT count(*) AS c FROM notes WHERE vec_id % 13 = 0)
, d AS (SELECT count(*) AS c FROM links WHERE from_note NOT IN (SELECT note_id FROM n) OR to_note NOT IN (SELECT note_id FROM n)), v AS (SELECT count(DISTINCT session_id) AS c FROM n WHERE vec_id % 9 = 0)
, b AS (SELECT count(*) AS c FROM health WHERE cooldown > 9e11)
SELECT * FROM (VALUES ('concurrent readers', 'ok', 'tables are written whole and replaced whole', false), ('schema', 'warn', 'missing: mutes', true), ('store integrity', 'ok', 'keys are unique', false),
  ('config permissions', 'warn', 'was 0644', true), ('digest flag', 'ok', 'no pending flag or a digest for it', false), ('provider key', 'fail', 'no key for offline', false), ('sources', 'ok', 'editors (1 files), logs (3 files)', false),
  ('embedding model', 'ok', 'cached', false), ('last refresh', 'warn', '19 days ago', false)) AS x(name, status, detail, repairable)
UNION ALL SELECT 'orphaned embeddings', CASE WHEN c > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN c > 0 THEN c || ' rows without a note' ELSE 'none' END, c > 0 FROM o
UNION ALL SELECT 'dangling links', CASE WHEN c > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN c > 0 THEN c || ' links to missing notes' ELSE 'none' END, c > 0 FROM d
UNION ALL SELECT 'model cooldowns', CASE WHEN c > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN c > 0 THEN c || ' impossible cooldowns' ELSE 'none' END, c > 0 FROM b
UNION ALL SELECT 'pipeline version', CASE WHEN c > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN c > 0 THEN c || ' sessions distilled by an older pipeline' ELSE 'version 2 everywhere' END, false FROM v""",
    "doctor_repair": """SELECT name, CASE name WHEN 'last refresh' THEN 'warn' ELSE 'ok' END AS status FROM (SELECT unnest(['concurrent readers', 'schema', 'store integrity', 'orphaned embeddings', 'dangling links', 'config permissions', 'digest flag',
  'model cooldowns', 'provider key', 'sources', 'embedding model', 'last refresh', 'pipeline version']) AS name)""",
    "themes_data": "SELECT * FROM data",
    "themes_sorted": """SELECT * FROM (SELECT 'sessions/all' AS view, theme_id FROM data ORDER BY session_count DESC, theme_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'notes/open', theme_id FROM data WHERE status = 'open' AND NOT is_muted ORDER BY n_notes DESC, session_count DESC, theme_id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'recent/muted', theme_id FROM data WHERE is_muted ORDER BY last_day DESC, session_count DESC, theme_id LIMIT 8)""",
    "arcs_shown": "SELECT theme_id, first_us FROM themes WHERE status IN ('open', 'dormant') ORDER BY first_us, theme_id LIMIT 12",
    "links_data": """, p AS (SELECT least(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_a, greatest(coalesce(from_theme, '?'), coalesce(to_theme, '?')) AS theme_b,
  count(*) AS n_links, round(max(weight), 3) AS max_weight, arg_max(link_id, (weight, from_note, to_note)) AS s FROM links GROUP BY ALL)
SELECT theme_a, theme_b, n_links, max_weight, substr(from_text, 1, 200) AS from_text, from_source, substr(to_text, 1, 200) AS to_text, to_source, why FROM p JOIN told_links ON link_id = s""",
    "digests_data": "SELECT digest_id, count(*) AS n_items, min('event ' || event_id) AS first_snapshot FROM log GROUP BY digest_id UNION ALL SELECT (SELECT max(digest_id) FROM digests), count(*), min(label) FROM fresh",
    "search_notes": """, h AS (SELECT note_id, score FROM near ORDER BY score DESC, note_id LIMIT 12)
SELECT h.note_id, substr(n.text, 1, 220) AS text, n.kind, n.source, strftime(make_timestamp(n.created_us), '%Y-%m-%d') AS date, round(h.score, 3) AS score, t.theme_id, t.label AS theme_label FROM h JOIN notes n ON n.note_id = h.note_id LEFT JOIN themes t ON t.theme_id = n.theme_id""",
    "topics_listed": "SELECT theme_id, session_count FROM themes WHERE lower(trim(label)) NOT IN (SELECT label_lc FROM muted) ORDER BY session_count DESC, theme_id LIMIT 10",
    "now_view": """, l AS (SELECT * FROM themes WHERE status IN ('open', 'dormant') ORDER BY session_count DESC, theme_id LIMIT 3), b AS (SELECT * FROM told_links ORDER BY weight DESC, from_note, to_note LIMIT 3)
SELECT 0 AS branch, 1 AS n, 'themes: ' || count(*) AS line FROM themes UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY session_count DESC, theme_id) AS INTEGER), label || '  [' || status || '] · ' || session_count || ' sessions' FROM l
UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY weight DESC, from_note, to_note) AS INTEGER), substr(from_text, 1, 52) || ' ↔ ' || substr(to_text, 1, 52) FROM b UNION ALL SELECT 3, 1, 'last refresh was degraded by provider rate limits — some labels/statuses may be incomplete'""",
    "recall_warnings": """SELECT conv_id AS user_id, CASE WHEN conv_id % 3 = 0 THEN 'no refresh has run yet — recall sees only what''s been distilled' ELSE 'last refresh was degraded by provider rate limits — some labels/statuses may be incomplete' END AS warning
FROM sessions WHERE conv_id % 3 = 0 OR conv_id % 6 = 1""",
    "status_report": "SELECT data_class, sum(n_rows)::BIGINT AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM storage GROUP BY data_class",
    "emitted_themes": """SELECT theme_id AS key, '{"theme_id":"' || theme_id || '","session_count":' || session_count || ',"status":"' || status || '"}' AS json FROM themes""",
    "clamp_limit": "SELECT n_nationkey, CAST(greatest(1, least(25, n_nationkey * 3 - 9)) AS INTEGER) AS n FROM nation",
    "demo_seed": """, n AS (SELECT 'links' AS name, count(*) AS n FROM links UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'themes', count(*) FROM themes)
SELECT 'first/' || name AS part, n AS n_rows FROM n UNION ALL SELECT 'again/' || name, 0 FROM n""",
    "model_health": _HEALTH + """
SELECT provider, model, round(cooldown_until, 3) AS cooldown_until, rung, consecutive, round(est_rate, 6) AS est_rate, round(last_success, 3) AS last_success, round(last_call, 3) AS last_call, calls, sent_bytes, recv_bytes FROM healthy""",
    "model_choice": _HEALTH + """, chains AS (SELECT CASE WHEN provider = 'p0' THEN 'propose' ELSE provider END AS role, ascii(model) AS pos, * FROM healthy), present AS (SELECT max(last_call) - 1800 AS now FROM healthy),
offered AS (SELECT * FROM chains WHERE role <> 'propose' UNION ALL SELECT * FROM (SELECT * FROM chains WHERE role = 'propose' ORDER BY pos, provider, model LIMIT 1))
SELECT role, min_by(provider, (pos, provider, model)) FILTER (WHERE cooldown_until <= now) AS provider, min_by(model, (pos, provider, model)) FILTER (WHERE cooldown_until <= now) AS model,
  CASE WHEN count(*) FILTER (WHERE cooldown_until <= now) = 0 THEN round(min(cooldown_until), 3) END AS until FROM offered, present GROUP BY role""",
    "stream_ingest": "SELECT session_id, count(*) AS n_messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY idx)) AS content_sha FROM told WHERE conv_id % 2 = 0 OR idx < 2 GROUP BY session_id",
}

ORACLES = {name: f"WITH {_BASE.strip()}{tail if tail.startswith(',') else chr(10) + tail}" for name, tail in _TAILS.items()}
