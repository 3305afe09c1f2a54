"""Reconciling clusters: proposals, approval, merging and retiring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm

#: Actions of a proposal (fixed values); only the first two change anything.
ACTIONS = ("duplicate", "contradiction", "related", "unrelated", "subagent-needed")
REASON_CAP = 200


def judge(members: DataFrame) -> DataFrame:
    """Deterministic judgement of (cluster, id, text or its digest, label): cluster, action, primary, n_members.

    Equal texts are duplicates (the oldest stays), different labels contradict (the newest stays), four or more members need a
    second look, a single member is unrelated, all else related.
    """
    digest = F.col("digest") if "digest" in members.columns else F.md5("text")
    g = members.groupBy("cluster").agg(
        F.count("*").alias("n_members"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.min(digest).alias("t0"), F.max(digest).alias("t1"), F.min(F.coalesce("label", F.lit(""))).alias("l0"), F.max(F.coalesce("label", F.lit(""))).alias("l1"),
    )
    one = F.col("n_members") == 1
    action = (
        F.when(~one & (F.col("t0") == F.col("t1")), "duplicate").when(~one & (F.col("l0") != F.col("l1")), "contradiction")
        .when(F.col("n_members") >= 4, "subagent-needed").when(one, "unrelated").otherwise("related")
    )
    return g.select("cluster", action.alias("action"), F.when(action == "contradiction", F.col("hi")).otherwise(F.col("lo")).alias("primary_id"), "n_members")


def valid(action: Column) -> Column:
    return F.coalesce(action.isin(*ACTIONS), F.lit(False))


def parse_proposals(lines: DataFrame) -> DataFrame:
    """Proposals of JSON lines: lines that are no object and unreadable ones are skipped; a missing key or an unknown action makes a row invalid."""
    schema = "cluster_id string, action string, primary string, others array<string>, rationale string"
    p = lines.where(F.trim("line").startswith("{")).select("line", F.from_json("line", schema).alias("p"), F.json_object_keys("line").alias("keys")).where("keys IS NOT NULL")
    full = F.size(F.array_intersect("keys", F.array(*[F.lit(k) for k in ("cluster_id", "action", "primary", "others", "rationale")]))) == 5
    return p.select("p.*", (full & valid(F.col("p.action"))).alias("is_valid"))


def approved(proposals: DataFrame, ids: list | None = None) -> DataFrame:
    """Duplicates and contradictions that are approved: all, or those of the given clusters."""
    out = proposals.where(F.col("action").isin("duplicate", "contradiction"))
    return out if ids is None else out.where(F.col("cluster").isin(ids))


def existing(proposals: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """Proposals of which every member exists."""
    there = members.join(entries.select("id").withColumn("_there", F.lit(True)), "id", "left").groupBy("cluster").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("all_exist"))
    return proposals.join(there, "cluster").select("cluster", "action", "all_exist")


def merged(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """Each approved duplicate: sorted union of labels, and of the sources in order of first occurrence (by member)."""
    m = proposals.where("action = 'duplicate'").join(members, "cluster")
    labels = m.where("label IS NOT NULL").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("topics"))
    firsts = m.where("origin IS NOT NULL").groupBy("cluster", "origin").agg(F.min("id").alias("at"))
    sources = firsts.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "origin"))), lambda x: x["origin"]), "|").alias("sources"))
    base = m.groupBy("cluster").agg(F.min("primary_id").alias("primary_id"), F.count("*").alias("n_merged"))
    return base.join(labels, "cluster", "left").join(sources, "cluster", "left").select("cluster", "primary_id", "n_merged", F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("sources", F.lit("")).alias("sources"))


def retired(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """Members that give way to the primary, with the reason (action and at most 200 characters of the rationale)."""
    rationale = F.format_string("%d members of cluster %d", F.col("n_members"), F.col("cluster"))
    m = approved(proposals).join(members.select("cluster", "id"), "cluster").where("id <> primary_id")
    return m.select("id", F.col("primary_id").alias("superseded_by"), F.concat("action", F.lit(": "), F.substring(rationale, 1, REASON_CAP)).alias("retired_reason"))


def cluster_blocks(records: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """A cluster's block of a judge's prompt, a row per line group so that no cluster is one string: (cluster_id, line_no, line), 0 the head, then a member each in order.

    ``entries`` are (id, name, text); a member without text gets its placeholder. Joined by line ends in order the rows are the block.
    """
    head = records.select("cluster", "cluster_id", F.lit(0).alias("line_no"), F.concat(F.lit("=== CLUSTER "), "cluster_id", F.lit(" ===")).alias("line"))
    body = members.join(records.select("cluster", "cluster_id"), "cluster").join(entries, "id", "left")
    body = body.withColumn("line_no", F.row_number().over(Window.partitionBy("cluster").orderBy("id")))
    name = F.coalesce("name", F.col("id").cast("string"))
    note = F.when(F.col("best_score").isNotNull(), F.concat(F.lit(" (score "), F.format_number("best_score", 3), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("--- ENTRY: "), name, note, F.lit(" ---\n"), F.coalesce("text", F.concat(F.lit("(entry file not found: "), name, F.lit(".md)"))), F.lit("\n"))
    return head.unionByName(body.select("cluster", "cluster_id", "line_no", line.alias("line"))).select("cluster_id", "line_no", "line")


def merged_documents(proposals: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """The document of each approved duplicate: (cluster, primary_id, document). The primary's keys and body stay; topics and sessions are united, and each entry that gives
    way is named under ``## Evidence (merged from)`` with its sessions.

    ``entries`` are (id, name, text, topics, sessions). Only names and lists of the others are gathered, never their texts.
    """
    m = proposals.where("action = 'duplicate'").select("cluster", "primary_id").join(members.select("cluster", "id"), "cluster").join(entries.drop("text"), "id")
    first = entries.select(F.col("id").alias("primary_id"), F.col("name").alias("primary_name"), "text")
    block = F.concat(F.lit("### From `"), "name", F.lit("` (sessions: ["), F.array_join("sessions", ", "), F.lit("])\n\n_Merged into `"), "primary_name", F.lit("` by reconcile._"))
    m = m.join(first.select("primary_id", "primary_name"), "primary_id").withColumn("block", F.when(F.col("id") != F.col("primary_id"), block))
    lead = (F.col("id") != F.col("primary_id")).cast("int")
    g = m.groupBy("cluster", "primary_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(lead.alias("lead"), "id", "sessions"))), lambda x: x["sessions"]))).alias("sessions"),
        F.transform(F.array_sort(F.collect_list(F.when(lead > 0, F.struct("id", "block")))), lambda x: x["block"]).alias("blocks"),
    )
    doc = g.join(first, "primary_id")
    lists = {k: F.when(F.size(c) > 0, fm.render_list(F.col(c))) for k, c in (("topics", "topics"), ("source_sessions", "sessions"))}
    text = fm.rewrite_all(F.col("text"), lists)
    evidence = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n## Evidence (merged from)\n\n"), F.array_join("blocks", "\n\n"), F.lit("\n"))
    return doc.select("cluster", "primary_id", evidence.alias("document"))


def retired_documents(retired: DataFrame, entries: DataFrame, names: DataFrame, at: str) -> DataFrame:
    """The documents of retired entries with ``superseded_by``, ``retired_reason`` and ``retired_at`` in their frontmatter: (id, document)."""
    d = retired.join(entries.select("id", "text"), "id").join(names.select(F.col("id").alias("superseded_by"), F.col("name").alias("_by")), "superseded_by", "left")
    new = {"superseded_by": F.coalesce("_by", F.col("superseded_by").cast("string")), "retired_reason": F.col("retired_reason"), "retired_at": F.lit(at)}
    return d.select("id", fm.rewrite_all(F.col("text"), new).alias("document"))


def second_pass(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """Judge again, each by itself, the clusters that need a second look: members with the text of the primary are its duplicates, else the cluster is ``related``.

    A cluster whose members are not found keeps its placeholder; all other proposals stay as they are.
    """
    open_ = proposals.where("action = 'subagent-needed'")
    digest = members.select("cluster", "id", F.md5("text").alias("t"))
    first = digest.select(F.col("cluster"), F.col("id").alias("primary_id"), F.col("t").alias("p"))
    seen = open_.select("cluster", "primary_id").join(first, ["cluster", "primary_id"]).join(digest, "cluster").groupBy("cluster").agg(F.count_if((F.col("t") == F.col("p")) & (F.col("id") != F.col("primary_id"))).alias("n_equal"))
    action = F.when(F.col("n_equal") > 0, "duplicate").when(F.col("n_equal") == 0, "related").otherwise(F.col("action"))
    return proposals.where("action <> 'subagent-needed'").unionByName(open_.join(seen, "cluster", "left").withColumn("action", action).select(*proposals.columns))


def rejudge(proposals: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters that need a second look, with what they hold; a cluster that is not found keeps its placeholder."""
    held = members.groupBy("cluster").agg(F.count("*").alias("found"))
    return proposals.where("action = 'subagent-needed'").select("cluster").join(held, "cluster", "left").select("cluster", F.coalesce("found", F.lit(0)).alias("found"))


def prompt_tokens(members: DataFrame) -> DataFrame:
    """Estimated tokens of each cluster in a judge's prompt: a quarter of its characters; a missing text counts as its placeholder. In place of the text, members may have its length as ``text_chars``."""
    chars = F.coalesce("text_chars", F.lit(len("(missing)"))) if "text_chars" in members.columns else F.char_length(F.coalesce("text", F.lit("(missing)")))
    n = F.floor(chars / 4)
    return members.groupBy("cluster").agg(F.sum(n).alias("prompt_tokens"))
