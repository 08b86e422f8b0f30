"""Schemas of the logical tables; readers never infer them."""

from __future__ import annotations

MESSAGE = "struct<role: string, text: string, ts: timestamp>"
SESSION = f"id string, user_id string, source string, native_id string, title string, started_at timestamp, ended_at timestamp, messages array<{MESSAGE}>, content_hash string"
NOTE = "id string, user_id string, session_id string, span_ref string, kind string, text string, created_at timestamp, canonical_id string, pipeline_version int"
EMBEDDING = "user_id string, note_id string, vec array<float>"
THEME = "id string, user_id string, label string, summary string, note_ids array<string>, first_seen timestamp, last_seen timestamp, session_count long, source_count long, status string"
LINK = "id string, user_id string, from_note_id string, to_note_id string, from_theme_id string, to_theme_id string, kind string, weight double, why string"
PROPOSAL = "id string, user_id string, kind string, source_ref string, source_hash string, title string, text string, next_step string, cites array<string>, novelty_sim double, feasibility int, outcome string, reject_reason string, rated_at timestamp, rated_via string"
DIGEST_ITEM = "digest_id long, n int, kind string, ref string, theme_ref string, snapshot string, outcome string"
