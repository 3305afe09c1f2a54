"""Ingest: gates, dedup against the manifest, and bounded first and last values of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE, SOFT, SHORT, CUTOFF, HEAD = 1_000_000_000, 250_000, 10_000, "2026-04-28", 20


def truthy(c: Column) -> Column:
    """NULL for a missing or empty string."""
    return F.nullif(c, F.lit(""))


def logical_id(session_id: Column, part_index: Column) -> Column:
    """The session of a part: the last ``_part_`` suffix goes, for part rows only."""
    return F.when(part_index.isNotNull(), F.regexp_replace(session_id, r"_part_\d+$", "")).otherwise(session_id)


def size_bucket(n_bytes: Column, large: int = LARGE, soft: int = SOFT, short: int = SHORT) -> Column:
    """skipped-large, chunk, short or whole; all bounds are strict, a missing size is ``unknown``."""
    return F.when(n_bytes.isNull(), "unknown").when(n_bytes > large, "skipped-large").when(n_bytes > soft, "chunk").when(n_bytes < short, "short").otherwise("whole")


def admitted(started_at: Column, cutoff: str = CUTOFF) -> Column:
    """Started on or after the cutoff day, or start unknown."""
    return (F.coalesce(started_at, F.lit("")) == "") | (F.substring(started_at, 1, 10) >= cutoff)


def memory_query(agent: Column) -> Column:
    return F.coalesce(F.lower(agent).contains("memory"), F.lit(False))


def new_sessions(transcripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions that the manifest does not have, neither whole nor as parts."""
    known = manifest.select(logical_id(F.col("session_id"), F.col("part_index")).alias("session_id")).distinct()
    return transcripts.where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n_rows")).join(known, "session_id", "left_anti")


def outcomes(transcripts: DataFrame, manifest: DataFrame, large: int = LARGE) -> DataFrame:
    """What a run does with each session: (session_id, outcome) of ingested, skipped_known, skipped_large, or errors for a session none of whose records has a type."""
    known = manifest.select(logical_id(F.col("session_id"), F.col("part_index")).alias("session_id")).distinct().withColumn("_known", F.lit(True))
    one = transcripts.where("session_id IS NOT NULL").groupBy("session_id").agg(F.sum(F.coalesce(F.octet_length("msg_content"), F.lit(0)).cast("long")).alias("n"), F.count_if(F.coalesce("rec_type", F.lit("")) != "").alias("typed"))
    what = F.when(F.col("_known"), "skipped_known").when(F.col("n") > large, "skipped_large").when(F.col("typed") == 0, "errors").otherwise("ingested")
    return one.join(known, "session_id", "left").select("session_id", what.alias("outcome"))


def bronze_filename(session_id: Column, modified_at: Column) -> Column:
    """Day of the last change (UTC) and session."""
    return F.concat(F.date_format(modified_at, "yyyy-MM-dd"), F.lit("_"), session_id, F.lit(".jsonl"))


def subagent_filename(session_id: Column, started_at: Column, modified_at: Column) -> Column:
    """As a session's, but by the day it started, if that is known."""
    return F.concat(F.coalesce(F.nullif(F.substring(started_at, 1, 10), F.lit("")), F.date_format(modified_at, "yyyy-MM-dd")), F.lit("_"), session_id, F.lit(".jsonl"))


def sidecar_latest(sidecar: DataFrame) -> DataFrame:
    """The last row of each session; rows without session id are skipped."""
    cols = [c for c in sidecar.columns if c != "session_id"]
    order = F.struct("started_at", "hook_version", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols if c not in ("started_at", "hook_version")])
    return sidecar.where(truthy(F.col("session_id")).isNotNull()).groupBy("session_id").agg(F.max_by(F.struct(*cols), order).alias("s")).select("session_id", "s.*")


def gate(transcripts: DataFrame, sidecar: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Sessions with a sidecar row that started on or after the cutoff, with their project and thread."""
    ids = transcripts.where("session_id IS NOT NULL").select("session_id").distinct()
    return ids.join(sidecar_latest(sidecar), "session_id").where(admitted(F.col("started_at"), cutoff)).select("session_id", "started_at", "project_id", "thread_id")


def metadata_first(transcripts: DataFrame, head: int = HEAD) -> DataFrame:
    """First non-empty cwd and branch of any record, and first time of another than a permission record, in a session's head.

    A row is in the head if fewer than ``head`` other than permission rows come before it. The bound is found by a limited rank, so a
    hot session sends only ``head`` rows of each task.
    """
    t = transcripts.where("session_id IS NOT NULL").select("session_id", "rec_id", "rec_ts", "cwd", "git_branch", (F.coalesce("rec_type", F.lit("")) == "permission-mode").alias("perm"))
    w = Window.partitionBy("session_id").orderBy("rec_id")
    lead = t.where("NOT perm").select("session_id", "rec_id").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= head)
    bound = lead.groupBy("session_id").agg(F.max("rec_id").alias("_last"), F.count("*").alias("_n"))
    scope = t.join(bound, "session_id", "left").where(F.col("_last").isNull() | (F.col("_n") < head) | (F.col("rec_id") <= F.col("_last")))
    first = lambda c, ok: F.min_by(truthy(F.col(c)), F.when(truthy(F.col(c)).isNotNull() & ok, F.col("rec_id")))
    return scope.groupBy("session_id").agg(first("cwd", F.lit(True)).alias("cwd"), first("git_branch", F.lit(True)).alias("git_branch"), first("rec_ts", ~F.col("perm")).alias("started_at"))


def agent_last(transcripts: DataFrame, head: int = HEAD) -> DataFrame:
    """Last agent name (of agent-name records) and last parent session in the first ``head`` rows; empty becomes NULL."""
    w = Window.partitionBy("session_id").orderBy("rec_id")
    t = transcripts.where("session_id IS NOT NULL").select("session_id", "rec_id", "rec_type", "agent_name", "parent_session_id")
    t = t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= head)
    return t.groupBy("session_id").agg(
        F.max_by(truthy(F.col("agent_name")), F.when(F.col("rec_type") == "agent-name", F.col("rec_id"))).alias("agent_name"),
        F.max_by(truthy(F.col("parent_session_id")), F.when(F.col("parent_session_id").isNotNull(), F.col("rec_id"))).alias("parent_session_id"),
    )


def message_count(transcripts: DataFrame) -> DataFrame:
    is_msg = F.coalesce("rec_type", F.lit("")).isin("user", "assistant")
    return transcripts.where("session_id IS NOT NULL").groupBy("session_id").agg(F.count_if(is_msg).alias("n_messages"), F.count("*").alias("n_rows"))


def subagent_meta(meta: DataFrame) -> DataFrame:
    """Type and task of a subagent; unreadable or other than an object gives NULLs, an empty text NULL, the task has 500 characters at most."""
    v = F.try_parse_json("raw_meta")
    get = lambda k: truthy(F.try_variant_get(v, f"$.{k}", "string"))
    return meta.select("session_id", "parent_session_id", get("agentType").alias("agent"), F.substring(get("description"), 1, 500).alias("agent_task"))


def subagent_sessions(transcripts: DataFrame, meta: DataFrame) -> DataFrame:
    """The sessions of subagents with what their metadata say: (session_id, parent_session_id, agent, agent_task, n_rows); a session without metadata has NULLs, of several the first parent's hold."""
    known = subagent_meta(meta).groupBy("session_id").agg(F.min(F.struct("parent_session_id", "agent", "agent_task")).alias("m")).select("session_id", "m.*")
    some = transcripts.where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("parent_session_id").alias("_p"), F.count("*").alias("n_rows"))
    both = some.join(known, "session_id", "left").where("_p IS NOT NULL OR parent_session_id IS NOT NULL")
    return both.select("session_id", F.coalesce("parent_session_id", "_p").alias("parent_session_id"), "agent", "agent_task", "n_rows")


def manifest_latest(manifest: DataFrame) -> DataFrame:
    """The row that holds of each manifest key: rows appended later supersede; the latest stage time decides, then the status."""
    order = F.struct(F.greatest(*[F.coalesce(c, F.lit("")) for c in ("ingested_at", "compacted_at", "extracted_at")]), "status", F.coalesce("bronze_size_bytes", F.lit(-1)))
    cols = [c for c in manifest.columns if c != "session_id"]
    return manifest.groupBy("session_id").agg(F.max_by(F.struct(*cols), order).alias("m")).select("session_id", "m.*")
