"""Compaction: eligibility, order, offsets and rendering of silver documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import logical_id

MIN_BYTES, LOW, HIGH = 30_000, 0.01, 0.30
#: Keys of a silver document's frontmatter, in order (fixed values).
SILVER_KEYS = ("session_id", "project_hash", "project", "agent", "agent_task", "parent_session", "ingested_at", "harness", "cwd", "git_branch", "session_started_at", "thread_id")


def eligible(min_bytes: int = MIN_BYTES) -> Column:
    """Bronze, no memory query, and a part or neither short nor small."""
    c = F.col
    big = ~F.coalesce(c("is_short"), F.lit(False)) & (F.coalesce(c("bronze_size_bytes"), F.lit(0)) >= min_bytes)
    return (c("status") == "bronze") & ~F.coalesce(c("memory_query"), F.lit(False)) & (c("part_index").isNotNull() | big)


def predecessor_ready(manifest: DataFrame, statuses: tuple[str, ...] = ("silver",)) -> DataFrame:
    """Each part with whether the part before it is compacted; part 1 and whole sessions always pass."""
    m = manifest.select("session_id", "part_index", "status", logical_id(F.col("session_id"), F.col("part_index")).alias("logical"))
    before = m.where("part_index IS NOT NULL").select(F.col("logical").alias("_l"), (F.col("part_index") + 1).alias("_p"), F.col("status").isin(*statuses).alias("_ok")).groupBy("_l", "_p").agg(F.bool_or("_ok").alias("_ok"))
    out = m.join(before, (m.logical == before._l) & (m.part_index == before._p), "left")
    return out.select("session_id", "part_index", "status", (F.coalesce("part_index", F.lit(1)) <= 1).alias("_f"), "_ok").withColumn("ready", F.col("_f") | F.coalesce("_ok", F.lit(False))).drop("_f", "_ok")


def processing_order(manifest: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` eligible rows in the order of logical session and part."""
    logical = logical_id(F.col("session_id"), F.col("part_index"))
    return manifest.where(eligible()).select("session_id", logical.alias("logical_id"), F.coalesce("part_index", F.lit(0)).alias("part_no")).orderBy("logical_id", "part_no", "session_id").limit(limit)


def silver_offsets(manifest: DataFrame) -> DataFrame:
    """Byte offset of each part in its silver document: the sizes of the parts before it."""
    w = Window.partitionBy("silver_path").orderBy(F.coalesce("part_index", F.lit(0)), "session_id").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.where("silver_path IS NOT NULL AND silver_size_bytes IS NOT NULL")
    return m.select("session_id", "silver_path", "part_index", F.coalesce(F.sum("silver_size_bytes").over(w), F.lit(0)).alias("offset_bytes"))


def project_slug(project_hash: Column) -> Column:
    """The project's part of an encoded home directory, else the input."""
    return F.coalesce(F.nullif(F.regexp_extract(project_hash, r"^-(?:Users|home)-[^-]+-(?:src|code|work|Business|Desktop|Documents)-(.+)$", 1), F.lit("")), project_hash)


def url_basename(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[/:]([^/:]+?)(?:\.git)?$", 1), F.lit(""))


def frontmatter(manifest: DataFrame) -> DataFrame:
    """The frontmatter of each silver document; NULL is spelt ``null``, parts carry their logical session's id."""
    m = manifest.withColumns({"session_id": logical_id(F.col("session_id"), F.col("part_index")), "project": F.coalesce("project", project_slug(F.col("project_hash"))), "_key": F.col("session_id")})
    rows = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in SILVER_KEYS]
    return m.select(F.col("_key").alias("manifest_id"), F.concat_ws("\n", F.lit("---"), *rows, F.lit("---")).alias("frontmatter"))


def silver_filename(manifest: DataFrame) -> DataFrame:
    logical = logical_id(F.col("session_id"), F.col("part_index"))
    return manifest.select("session_id", F.concat(F.substring("ingested_at", 1, 10), F.lit("-"), F.substring(logical, 1, 13), F.lit(".md")).alias("file_name"))


def prompt_route(manifest: DataFrame) -> DataFrame:
    """Which prompt a row takes, and the tags of a continuation's input."""
    more = F.coalesce("part_index", F.lit(1)) > 1
    info = F.format_string("<part-info>part_index=%d total_parts=%d</part-info>", F.col("part_index"), F.coalesce("total_parts", F.col("part_index")))
    return manifest.select("session_id", F.when(more, "continue").otherwise("fresh").alias("prompt"), F.when(more, info).alias("part_info"))


def continuation(manifest: DataFrame, silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """The input of each continuation: the silver document so far (silver_path, text), the part's place, the part's bronze text (session_id, text); a missing text is empty."""
    more = prompt_route(manifest).where("prompt = 'continue'").join(manifest.select("session_id", "silver_path"), "session_id")
    more = more.join(silver.select("silver_path", F.col("text").alias("_s")), "silver_path", "left").join(bronze.select("session_id", F.col("text").alias("_b")), "session_id", "left")
    none = F.lit("")
    text = F.concat(F.lit("<prior-silver>\n"), F.coalesce("_s", none), F.lit("\n</prior-silver>\n\n"), "part_info", F.lit("\n\n<bronze-part>\n"), F.coalesce("_b", none), F.lit("\n</bronze-part>"))
    return more.select("session_id", text.alias("input"))


def ratio_band(manifest: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Silver to bronze bytes; an empty bronze has no ratio."""
    ratio = F.when(F.col("bronze_size_bytes") > 0, F.col("silver_size_bytes") / F.col("bronze_size_bytes"))
    m = manifest.where("silver_size_bytes IS NOT NULL AND bronze_size_bytes IS NOT NULL").select("session_id", F.round(ratio, 4).alias("ratio"), ratio.alias("_r"))
    band = F.when(F.col("_r").isNull(), "no-bronze").when(F.col("_r") < low, "echo").when(F.col("_r") > high, "long").otherwise("good")
    return m.select("session_id", "ratio", band.alias("band"))
