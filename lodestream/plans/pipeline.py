"""Queries of ingest and compaction over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, compaction, ingest
from ..operators.records import is_human
from ..session import table

SOFT, DAY = 20_000, "2024-06-01"


def _t(name):
    return lambda spark, d: table(spark, d, name)


T, M, SC = _t("transcripts"), _t("manifest"), _t("sidecar")


def _latest(spark, d):
    return ingest.manifest_latest(M(spark, d))


HUMAN = "(coalesce(rec_type, '') = 'user' AND coalesce(nullif(lower(trim(msg_role)), ''), 'user') = 'user')"
LOGICAL = "CASE WHEN part_index IS NOT NULL THEN regexp_replace(session_id, '_part_[0-9]+$', '') ELSE session_id END"
LATEST = """latest AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY greatest(coalesce(ingested_at, ''), coalesce(compacted_at, ''), coalesce(extracted_at, '')) DESC, status DESC, coalesce(bronze_size_bytes, -1) DESC) AS _rn FROM manifest) WHERE _rn = 1)"""
ELIGIBLE = "status = 'bronze' AND NOT coalesce(memory_query, false) AND (part_index IS NOT NULL OR (NOT coalesce(is_short, false) AND coalesce(bronze_size_bytes, 0) >= 30000))"
SIDE = "side AS (SELECT session_id, max(started_at) AS started_at FROM sidecar WHERE nullif(session_id, '') IS NOT NULL GROUP BY 1)"
SIDE_LAST = """side AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC NULLS LAST, hook_version DESC NULLS LAST, coalesce(cwd, '') DESC, coalesce(repo_root, '') DESC, coalesce(project_id, '') DESC, coalesce(branch, '') DESC, coalesce(thread_id, '') DESC, coalesce(hook_source, '') DESC) AS _rn FROM sidecar WHERE nullif(session_id, '') IS NOT NULL) WHERE _rn = 1)"""

QUERIES = {
    "chunk_plan": lambda s, d: chunking.chunk_plan(T(s, d), SOFT),
    "chunk_invariants": lambda s, d: chunking.chunk_plan(T(s, d), SOFT).groupBy("session_id").agg(F.sum("part_bytes").alias("session_bytes"), F.max("total_parts").alias("total_parts")),
    "session_metadata_first": lambda s, d: ingest.metadata_first(T(s, d)),
    "agent_last_wins": lambda s, d: ingest.agent_last(T(s, d)),
    "message_count": lambda s, d: ingest.message_count(T(s, d)),
    "size_buckets": lambda s, d: M(s, d).groupBy(ingest.size_bucket(F.col("bronze_size_bytes"), soft=SOFT).alias("bucket")).agg(F.count("*").alias("n")),
    "user_turns": lambda s, d: T(s, d).where(is_human(F.col("rec_type"), F.col("msg_role"))).select("rec_id", "session_id"),
    "sidecar_latest": lambda s, d: ingest.sidecar_latest(SC(s, d)).select("session_id", "started_at", "cwd", "branch", "thread_id", "hook_version"),
    "sidecar_gate": lambda s, d: ingest.gate(T(s, d), SC(s, d), DAY),
    "new_sessions_anti": lambda s, d: ingest.new_sessions(T(s, d), M(s, d)),
    "subagent_meta": lambda s, d: ingest.subagent_meta(table(s, d, "subagent_meta")),
    "subagent_sessions": lambda s, d: ingest.subagent_sessions(T(s, d), table(s, d, "subagent_meta")),
    "memory_queries": lambda s, d: M(s, d).where(ingest.memory_query(F.col("agent"))).select("session_id", "agent"),
    "manifest_update": lambda s, d: _latest(s, d).select("session_id", "status", "bronze_size_bytes", "silver_path"),
    "compact_eligible": lambda s, d: _latest(s, d).where(compaction.eligible()).select("session_id", "bronze_size_bytes", "part_index"),
    "predecessor_ready": lambda s, d: compaction.predecessor_ready(_latest(s, d)),
    "processing_order": lambda s, d: compaction.processing_order(_latest(s, d), 100),
    "silver_offsets": lambda s, d: compaction.silver_offsets(_latest(s, d)),
    "project_slug": lambda s, d: M(s, d).select("project_hash").distinct().select("project_hash", compaction.project_slug(F.col("project_hash")).alias("slug")),
    "git_basename": lambda s, d: SC(s, d).select("repo_root").distinct().select("repo_root", compaction.url_basename(F.col("repo_root")).alias("base_name")),
    "silver_document": lambda s, d: compaction.frontmatter(_latest(s, d).where("silver_path IS NOT NULL")),
    "silver_filename": lambda s, d: compaction.silver_filename(_latest(s, d)),
    "bronze_filename": lambda s, d: T(s, d).where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("loaded_at").alias("m"), F.min("rec_ts").alias("t")).select("session_id", ingest.bronze_filename(F.col("session_id"), F.col("m")).alias("file_name"), ingest.subagent_filename(F.col("session_id"), F.col("t"), F.col("m")).alias("subagent_file_name")),
    "prompt_route": lambda s, d: compaction.prompt_route(_latest(s, d)),
    "ratio_bands": lambda s, d: compaction.ratio_band(_latest(s, d)),
}

_PLAN = f"""WITH RECURSIVE l AS (SELECT session_id, rec_id, coalesce(strlen(msg_content), 0) + 1 AS b, {HUMAN} AS h FROM transcripts WHERE session_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rec_id) AS i, coalesce(lead(h) OVER (PARTITION BY session_id ORDER BY rec_id), false) AS nh, sum(b) OVER (PARTITION BY session_id) AS total FROM l),
p AS (SELECT *, CAST(ceil(total / {SOFT}.0) AS BIGINT) AS parts FROM n),
q AS (SELECT *, CASE WHEN total <= {SOFT} THEN total + 1 ELSE total // parts END AS target FROM p),
r AS (SELECT session_id, i, 1 AS part, b AS cur FROM q WHERE i = 1 UNION ALL
 SELECT q.session_id, q.i, r.part + CASE WHEN x.nh AND r.cur >= x.target AND r.part < x.parts THEN 1 ELSE 0 END, CASE WHEN x.nh AND r.cur >= x.target AND r.part < x.parts THEN q.b ELSE r.cur + q.b END
 FROM r JOIN q ON q.session_id = r.session_id AND q.i = r.i + 1 JOIN q x ON x.session_id = r.session_id AND x.i = r.i),
plan AS (SELECT session_id, part AS part_index, min(rec_id) AS first_rec, max(rec_id) AS last_rec, CAST(sum(b) AS BIGINT) AS part_bytes FROM r JOIN q USING (session_id, i) GROUP BY 1, 2)"""
ORACLE = {
    "bronze_filename": "WITH b AS (SELECT session_id, max(loaded_at) AS m, min(rec_ts) AS t FROM transcripts WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_id, concat(strftime(m, '%Y-%m-%d'), '_', session_id, '.jsonl') AS file_name, concat(coalesce(nullif(substr(t, 1, 10), ''), strftime(m, '%Y-%m-%d')), '_', session_id, '.jsonl') AS subagent_file_name FROM b",
    "chunk_plan": _PLAN + " SELECT session_id, CAST(part_index AS BIGINT) AS part_index, count(*) OVER (PARTITION BY session_id) AS total_parts, first_rec, last_rec, part_bytes FROM plan",
    "chunk_invariants": f"""WITH l AS (SELECT session_id, CAST(sum(coalesce(strlen(msg_content), 0) + 1) AS BIGINT) AS session_bytes FROM transcripts WHERE session_id IS NOT NULL GROUP BY 1), p AS ({_PLAN} SELECT session_id, count(*) AS total_parts FROM plan GROUP BY 1) SELECT session_id, session_bytes, total_parts FROM l JOIN p USING (session_id)""",
    "session_metadata_first": """WITH t AS (SELECT session_id, rec_id, nullif(cwd, '') AS cwd, nullif(git_branch, '') AS git_branch, nullif(rec_ts, '') AS rec_ts, coalesce(rec_type, '') = 'permission-mode' AS perm FROM transcripts WHERE session_id IS NOT NULL),
s AS (SELECT *, coalesce(sum(CASE WHEN perm THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT session_id, arg_min(cwd, rec_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(git_branch, rec_id) FILTER (git_branch IS NOT NULL) AS git_branch, arg_min(rec_ts, rec_id) FILTER (rec_ts IS NOT NULL AND NOT perm) AS started_at FROM s WHERE before < 20 GROUP BY 1""",
    "agent_last_wins": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rec_id) AS rn FROM transcripts WHERE session_id IS NOT NULL)
SELECT session_id, nullif(arg_max(coalesce(agent_name, ''), rec_id) FILTER (rec_type = 'agent-name'), '') AS agent_name, nullif(arg_max(parent_session_id, rec_id) FILTER (parent_session_id IS NOT NULL), '') AS parent_session_id FROM s WHERE rn <= 20 GROUP BY 1""",
    "message_count": "SELECT session_id, count(*) FILTER (rec_type IN ('user', 'assistant')) AS n_messages, count(*) AS n_rows FROM transcripts WHERE session_id IS NOT NULL GROUP BY 1",
    "size_buckets": f"SELECT CASE WHEN bronze_size_bytes IS NULL THEN 'unknown' WHEN bronze_size_bytes > 1000000000 THEN 'skipped-large' WHEN bronze_size_bytes > {SOFT} THEN 'chunk' WHEN bronze_size_bytes < 10000 THEN 'short' ELSE 'whole' END AS bucket, count(*) AS n FROM manifest GROUP BY 1",
    "user_turns": f"SELECT rec_id, session_id FROM transcripts WHERE {HUMAN}",
    "sidecar_latest": f"WITH {SIDE_LAST} SELECT session_id, started_at, cwd, branch, thread_id, hook_version FROM side",
    "sidecar_gate": f"WITH {SIDE_LAST} SELECT session_id, started_at, project_id, thread_id FROM side WHERE (coalesce(started_at, '') = '' OR substr(started_at, 1, 10) >= '{DAY}') AND session_id IN (SELECT session_id FROM transcripts)",
    "new_sessions_anti": f"SELECT session_id, count(*) AS n_rows FROM transcripts WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT {LOGICAL} FROM manifest WHERE session_id IS NOT NULL) GROUP BY 1",
    "subagent_meta": """WITH m AS (SELECT *, CASE WHEN json_valid(raw_meta) AND json_type(raw_meta) = 'OBJECT' THEN raw_meta END AS j FROM subagent_meta)
SELECT session_id, parent_session_id, nullif(j ->> '$.agentType', '') AS agent, substr(nullif(j ->> '$.description', ''), 1, 500) AS agent_task FROM m""",
    "subagent_sessions": """WITH m AS (SELECT *, CASE WHEN json_valid(raw_meta) AND json_type(raw_meta) = 'OBJECT' THEN raw_meta END AS j FROM subagent_meta), k AS (SELECT session_id, parent_session_id AS p, nullif(j ->> '$.agentType', '') AS agent, substr(nullif(j ->> '$.description', ''), 1, 500) AS agent_task FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p NULLS FIRST, agent NULLS FIRST, agent_task NULLS FIRST) = 1),
t AS (SELECT session_id, min(parent_session_id) AS tp, count(*) AS n_rows FROM transcripts WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session_id, coalesce(p, tp) AS parent_session_id, agent, agent_task, n_rows FROM t LEFT JOIN k USING (session_id) WHERE tp IS NOT NULL OR p IS NOT NULL""",
    "memory_queries": "SELECT session_id, agent FROM manifest WHERE contains(lower(agent), 'memory')",
    "manifest_update": f"WITH {LATEST} SELECT session_id, status, bronze_size_bytes, silver_path FROM latest",
    "compact_eligible": f"WITH {LATEST} SELECT session_id, bronze_size_bytes, part_index FROM latest WHERE {ELIGIBLE}",
    "predecessor_ready": f"WITH {LATEST}, m AS (SELECT *, {LOGICAL} AS logical FROM latest) SELECT session_id, part_index, status, coalesce(part_index, 1) <= 1 OR EXISTS (SELECT 1 FROM m p WHERE p.logical = m.logical AND p.part_index = m.part_index - 1 AND p.status = 'silver') AS ready FROM m",
    "processing_order": f"WITH {LATEST} SELECT session_id, {LOGICAL} AS logical_id, coalesce(part_index, 0) AS part_no FROM latest WHERE {ELIGIBLE} ORDER BY 2, 3, 1 LIMIT 100",
    "silver_offsets": f"WITH {LATEST} SELECT session_id, silver_path, part_index, CAST(coalesce(sum(silver_size_bytes) OVER (PARTITION BY silver_path ORDER BY coalesce(part_index, 0), session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_bytes FROM latest WHERE silver_path IS NOT NULL AND silver_size_bytes IS NOT NULL",
    "project_slug": "SELECT DISTINCT project_hash, coalesce(nullif(regexp_extract(project_hash, '^-(?:Users|home)-[^-]+-(?:src|code|work|Business|Desktop|Documents)-(.+)$', 1), ''), project_hash) AS slug FROM manifest",
    "git_basename": "SELECT DISTINCT repo_root, nullif(regexp_extract(repo_root, '[/:]([^/:]+?)(?:\\.git)?$', 1), '') AS base_name FROM sidecar",
    "silver_document": f"WITH {LATEST} SELECT session_id AS manifest_id, concat_ws(chr(10), '---', "
    + ", ".join(
        f"'{k}: ' || coalesce({LOGICAL if k == 'session_id' else 'coalesce(project, coalesce(nullif(regexp_extract(project_hash, ' + chr(39) + '^-(?:Users|home)-[^-]+-(?:src|code|work|Business|Desktop|Documents)-(.+)$' + chr(39) + ', 1), ' + chr(39) * 2 + '), project_hash))' if k == 'project' else k}, 'null')"
        for k in compaction.SILVER_KEYS
    )
    + ", '---') AS frontmatter FROM latest WHERE silver_path IS NOT NULL",
    "silver_filename": f"WITH {LATEST} SELECT session_id, substr(ingested_at, 1, 10) || '-' || substr({LOGICAL}, 1, 13) || '.md' AS file_name FROM latest",
    "prompt_route": f"WITH {LATEST} SELECT session_id, CASE WHEN coalesce(part_index, 1) > 1 THEN 'continue' ELSE 'fresh' END AS prompt, CASE WHEN coalesce(part_index, 1) > 1 THEN printf('<part-info>part_index=%d total_parts=%d</part-info>', part_index, coalesce(total_parts, part_index)) END AS part_info FROM latest",
    "ratio_bands": f"WITH {LATEST}, r AS (SELECT session_id, CASE WHEN bronze_size_bytes > 0 THEN silver_size_bytes::DOUBLE / bronze_size_bytes END AS q FROM latest WHERE silver_size_bytes IS NOT NULL AND bronze_size_bytes IS NOT NULL) SELECT session_id, round(q, 4) AS ratio, CASE WHEN q IS NULL THEN 'no-bronze' WHEN q < 0.01 THEN 'echo' WHEN q > 0.3 THEN 'long' ELSE 'good' END AS band FROM r",
}
