"""Queries of the problems tagged llm, over the given tables."""

from __future__ import annotations

from ..session import table
from . import conversations, credentials, history_dedup, leakage, mixing, personal, shared_spans, splitting

def _leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {
    "p1_found": lambda spark, d: personal.found(table(spark, d, "transcripts")),
    "p1_redacted": lambda spark, d: personal.redact(table(spark, d, "transcripts")),
    "p2_found": lambda spark, d: history_dedup.repeats(table(spark, d, "gold_entries")),
    "p3_found": lambda spark, d: splitting.human_turns(table(spark, d, "transcripts")),
    "p3_parts": lambda spark, d: splitting.parts(table(spark, d, "transcripts")),
    "p3_texts": lambda spark, d: splitting.part_texts(table(spark, d, "transcripts")),
    "p3_pieces": lambda spark, d: splitting.pieces(table(spark, d, "transcripts")),
    "p4_found": lambda spark, d: conversations.rejected(conversations.segments(spark, f"{d}/transcripts.parquet")),
    "p4_conversations": lambda spark, d: conversations.kept(conversations.segments(spark, f"{d}/transcripts.parquet")),
    "p5_found": lambda spark, d: credentials.found(table(spark, d, "transcripts")),
    "p5_redacted": lambda spark, d: credentials.redact(table(spark, d, "transcripts")),
    "p8_found": lambda spark, d: _leaks(spark, d).select("doc_id", "item_id"),
    "p8_items": lambda spark, d: leakage.leaked_items(_leaks(spark, d)),
    "p9_mixture": _mixture,
    "p9_shares": lambda spark, d: mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets")),
    "p10_found": lambda spark, d: shared_spans.pairs(table(spark, d, "documents")),
    "p10_members": lambda spark, d: shared_spans.members(table(spark, d, "documents")),
    "p10_shares": lambda spark, d: shared_spans.shares(table(spark, d, "documents")),
}
_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), gi AS (SELECT DISTINCT item_id, array_to_string(w[n:n + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12)),
gd AS (SELECT DISTINCT doc_id, array_to_string(w[n:n + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d WHERE len(w) >= 12)), found AS (SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g))"""
ORACLE: dict[str, str] = {
    "p10_members": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE length(text) >= 300 QUALIFY n_copies > 1",
    "p3_found": """WITH h AS (SELECT * FROM transcripts WHERE uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) = 1),
s AS (SELECT session_id FROM h WHERE session_id IS NOT NULL GROUP BY 1 HAVING sum(coalesce(strlen(msg_content), 0)) > 20000)
SELECT session_id, uuid FROM h JOIN s USING (session_id) WHERE rec_type = 'user' AND coalesce(nullif(lower(trim(msg_role)), ''), 'user') = 'user'""",
    "p8_found": f"{_LEAKS} SELECT doc_id, item_id FROM found",
    "p10_found": """WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300), g AS (SELECT DISTINCT doc_id, md5(substr(text, n, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS n FROM t))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
