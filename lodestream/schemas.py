"""Explicit schemas of the file formats; a field that is missing reads as NULL."""

from __future__ import annotations

MANIFEST = (
    "session_id string, source_path string, bronze_path string, meta_path string, silver_path string, gold_paths array<string>, status string, ingested_at string, compacted_at string, extracted_at string, "
    "bronze_size_bytes long, silver_size_bytes long, error string, harness string, project_hash string, project string, agent string, agent_task string, parent_session string, short boolean, memory_query boolean, "
    "cwd string, git_branch string, session_started_at string, part_index int, total_parts int, silver_offset_bytes long, project_id string, sidecar_path string, thread_id string"
)
SIDECAR = "session_id string, started_at string, cwd string, repo_root string, project_id string, branch string, thread_id string, source string, hook_version int"
PROPOSAL = "cluster_id string, action string, primary string, others array<string>, rationale string"
