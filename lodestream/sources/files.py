"""File sources of the pipeline: session trees, manifests, sidecars, subagent metadata and Markdown entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import prefix_sums
from ..session import exists


def _one(col: str, n: int):
    return F.element_at(F.split(col, "/"), n)


def sessions(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Session files of a tree ``root/project/session.jsonl`` and, as subagents, ``root/project/session/subagents/agent-*.jsonl``.

    (path, project_hash, session_id, parent_session, n_bytes, modified_at); contents are not read. ``max_bytes`` is pushed into the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    files = files.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"))
    if max_bytes is not None:
        files = files.where(F.col("n_bytes") <= max_bytes)
    sub = F.coalesce(_one("path", -2) == "subagents", F.lit(False))
    named = files.where(~sub | _one("path", -1).startswith("agent-"))
    return named.select(
        "path", F.when(sub, _one("path", -4)).otherwise(_one("path", -2)).alias("project_hash"), F.regexp_replace(_one("path", -1), r"\.jsonl$", "").alias("session_id"),
        F.when(sub, _one("path", -3)).alias("parent_session"), "n_bytes", "modified_at",
    )


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, raw, rec) of the lines of session files, bytes exact; ``rec`` is NULL for unreadable lines, blank ones are left out but counted.

    Files are split like any text, so that a large session is several tasks; a line's number is its place in its split plus the lines of the splits before.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(paths)
    at = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    each = prefix_sums(at, ["path"], F.col("_block"), [F.col("_block"), F.col("_at")], {"_n": F.lit(1)})
    return each.where("raw <> ''").select("path", (F.col("_n") - 1).cast("int").alias("line_no"), "raw", F.try_parse_json("raw").alias("rec"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines, strictly: an unreadable line fails the read, blank lines are skipped, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    return spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").json(path)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster or proposal lines, strictly: (line, rec); the first unreadable line, with its file, is named in the error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    t = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), F.try_parse_json("value").alias("rec"))
    bad = t.where("rec IS NULL").select("path", F.substring("line", 1, 80).alias("line")).limit(1).collect()
    if bad:
        raise ValueError(f"Invalid JSON in {bad[0].path}: {bad[0].line!r}")
    return t.select("line", "rec")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar lines, leniently: unreadable lines and lines without session are skipped."""
    return spark.read.schema(schemas.SIDECAR).option("mode", "DROPMALFORMED").json(path).where("coalesce(session_id, '') <> ''")


def subagent_meta(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, raw_meta) of ``agent-*.meta.json`` files."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json").text(root)
    return t.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.meta\.json$", "").alias("session_id"), F.col("value").alias("raw_meta"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_id, text) of Markdown entries; retired ones are not read."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root)
    path = F.col("_metadata.file_path")
    return t.select(path.alias("path"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "").alias("file_id"), F.col("value").alias("text")).where("path NOT LIKE '%/_retired/%'")
