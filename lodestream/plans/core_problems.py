"""Queries of the general problems (6 and 7) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, nested
from ..session import materialize, table


def _ingested(spark, d):
    """The manifest lines with their rescue column, written once; changes and replay read nothing else."""
    return materialize(drift.ingest(table(spark, d, "manifest_files")), "ingested")


QUERIES = {
    "p6_found": lambda spark, d: nested.objects(table(spark, d, "transcripts")),
    "p6_texts": lambda spark, d: nested.typed_nodes(table(spark, d, "transcripts"), "text"),
    "p6_calls": lambda spark, d: nested.typed_nodes(table(spark, d, "transcripts"), "tool_use"),
    "p6_results": lambda spark, d: nested.typed_nodes(table(spark, d, "transcripts"), "tool_result"),
    "p6_items": lambda spark, d: nested.typed_nodes(table(spark, d, "transcripts"), None),
    "p7_found": lambda spark, d: drift.changes(_ingested(spark, d)),
    "p7_manifest": lambda spark, d: drift.replay(_ingested(spark, d)).withColumn("rescued", F.to_json("rescued")),
}
#: In SQL the places of a field are told by its words alone: (words, key of an object named by the field that is the place).
_FIELDS = {"cwd": ("cwd|dir(ectory)?($|[._])", ""), "git_branch": ("branch", ""), "session_started_at": ("start", ""), "thread_id": ("thread", "id")}
_PLACES = " UNION ALL ".join(
    f"""SELECT file_name, line_no, '{f}' AS field_name, path, v, CASE WHEN parent <> '' THEN 0 WHEN path = '{f}' THEN 1 ELSE 2 END AS rank FROM every
WHERE CASE WHEN parent = '' THEN regexp_matches(path, '(?i){w}') ELSE parent <> '{f}' AND (NOT regexp_matches(parent, '(?i){w}') AND regexp_matches(leaf, '(?i){w}') OR regexp_matches(parent, '(?i){w}') AND leaf = '{inner}') END"""
    for f, (w, inner) in _FIELDS.items()
)
ORACLE: dict[str, str] = {
    "p7_found": f"""WITH m AS (SELECT *, CASE WHEN json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' THEN raw_line::JSON END AS j FROM manifest_files), keyed AS (SELECT file_name, line_no, unnest(json_keys(j)) AS path, j FROM m WHERE j IS NOT NULL),
top AS (SELECT file_name, line_no, path, '' AS parent, path AS leaf, json_extract(j, '$."' || path || '"') AS v FROM keyed), deep AS (SELECT file_name, line_no, path AS parent, unnest(json_keys(v)) AS leaf, v FROM top WHERE json_type(v) = 'OBJECT'),
every AS (SELECT * FROM top UNION ALL SELECT file_name, line_no, parent || '.' || leaf, parent, leaf, json_extract(v, '$."' || leaf || '"') FROM deep), places AS ({_PLACES}),
best AS (SELECT * FROM places WHERE rank = 0 OR json_type(v) <> 'NULL' QUALIFY row_number() OVER (PARTITION BY file_name, line_no, field_name ORDER BY rank, path) = 1),
n AS (SELECT file_name, field_name, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, count(*) AS n FROM best WHERE json_type(v) <> 'NULL' GROUP BY ALL),
place AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY file_name, field_name ORDER BY n DESC, path, kind) = 1),
grid AS (SELECT f.*, field_name FROM (SELECT DISTINCT file_name, host, file_seq FROM manifest_files) f, (SELECT unnest(['cwd', 'git_branch', 'session_started_at', 'thread_id']) AS field_name)),
seen AS (SELECT grid.*, path, kind, lag(path) OVER w AS op, lag(kind) OVER w AS ok, row_number() OVER w AS r FROM grid LEFT JOIN place USING (file_name, field_name) WINDOW w AS (PARTITION BY host, field_name ORDER BY file_seq, file_name))
SELECT file_name, field_name, unnest(list_filter([CASE WHEN op IS NULL AND path IS NOT NULL THEN 'added' END, CASE WHEN path IS NULL AND op IS NOT NULL THEN 'removed' END, CASE WHEN path <> op THEN 'renamed' END, CASE WHEN kind <> ok THEN 'retyped' END], lambda x: x IS NOT NULL)) AS change_kind FROM seen WHERE r > 1""",
}
