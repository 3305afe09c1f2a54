"""Sinks: numbered snapshots instead of updates in place, on any Hadoop file system.

A snapshot is a folder ``v-N`` that counts once Spark has committed it; readers take the highest. A failed write leaves the last state as it was, and of two
writers of the same number the second fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, exists


def append(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Append rows; with ``dry_run`` nothing is written. Returns what is or would be appended."""
    if not dry_run:
        df.write.mode("append").parquet(path)
    return df


def _latest(spark: SparkSession, root: str) -> int:
    done = [int(n[2:]) for n in children(spark, root) if n.startswith("v-") and exists(spark, f"{root}/{n}/_SUCCESS")]
    return max(done, default=0)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table of the highest committed snapshot."""
    if not (n := _latest(spark, root)):
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/v-{n}")


def upsert(updates: DataFrame, root: str, key: str, dry_run: bool = False) -> DataFrame:
    """Update by key: fields that are not NULL in ``updates`` replace, unknown keys are an error, all else stays.

    The result is a new snapshot; the pointer is swapped last. Of repeated keys in ``updates`` the one with the largest values holds.
    """
    spark = updates.sparkSession
    base = current(spark, root)
    cols = [c for c in updates.columns if c != key]
    one = updates.groupBy(key).agg(F.max(F.struct(*cols)).alias("_u"))
    missing = one.join(base.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown {key}: {[r[key] for r in missing]}")
    new = base.join(one, key, "left").withColumns({c: F.coalesce(F.col(f"_u.{c}"), F.col(c)) for c in cols}).drop("_u")
    if not dry_run:
        publish(new, root)
    return new


def publish(df: DataFrame, root: str) -> str:
    """Write the next snapshot."""
    name = f"v-{_latest(df.sparkSession, root) + 1}"
    df.write.parquet(f"{root}/{name}")
    return name


def put_documents(docs: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Entries or silver documents (name, text): those of the same name are replaced, all others stay. Returns the new table; of repeated names the greatest text holds."""
    new = docs.groupBy("name").agg(F.max("text").alias("text"))
    spark = docs.sparkSession
    if _latest(spark, root):
        new = current(spark, root).select("name", "text").join(new.select("name"), "name", "left_anti").unionByName(new)
    if not dry_run:
        publish(new, root)
        return current(spark, root)
    return new


def retire(retired: DataFrame, entries_root: str, retired_root: str, dry_run: bool = False) -> DataFrame:
    """Move documents (name, text) out of the entries: first they are put among the retired, then a snapshot without them is published. Unknown names are an error."""
    spark = retired.sparkSession
    base = current(spark, entries_root)
    missing = retired.join(base.select("name"), "name", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown entries: {[r['name'] for r in missing]}")
    left = base.join(retired.select("name"), "name", "left_anti")
    if not dry_run:
        put_documents(retired, retired_root)
        publish(left, entries_root)
        return current(spark, entries_root)
    return left


def append_silver(sections: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Append sections (silver_path, part_index, section) to their documents: (name, text, offset_bytes), the size each document had before."""
    spark = sections.sparkSession
    new = sections.select("silver_path", "part_index", "section")
    old = current(spark, root).select(F.col("name").alias("silver_path"), F.lit(-1).alias("part_index"), F.col("text").alias("section")) if _latest(spark, root) else new.limit(0)
    touched = old.join(new.select("silver_path").distinct(), "silver_path", "left_semi")
    docs = silver_documents(touched.unionByName(new)).select(F.col("silver_path").alias("name"), "text")
    before = touched.select(F.col("silver_path").alias("name"), F.octet_length("section").cast("long").alias("offset_bytes"))
    out = docs.join(before, "name", "left").select("name", "text", F.coalesce("offset_bytes", F.lit(0)).alias("offset_bytes"))
    if not dry_run:
        put_documents(docs, root)
    return out


def copy_bronze(spark: SparkSession, source: str, files: DataFrame, root: str, harness: str, dry_run: bool = False) -> DataFrame:
    """Byte copies of the session files (path, session_id) of a tree: (session_id, content, n_bytes), under one folder for each harness."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(source).select("path", "content", F.col("length").alias("n_bytes"))
    out = files.select("path", "session_id").join(content, "path").select("session_id", "content", "n_bytes", F.lit(harness).alias("harness"))
    if not dry_run:
        out.write.mode("append").partitionBy("harness").parquet(root)
    return out


def write_parts(lines: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Part files from lines (session_id, part_index, line_no, raw): (session_id, part_index, content), the raw lines of a part as they were, each with its line end."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: F.concat(x["raw"], F.lit("\n"))), "")
    out = lines.groupBy("session_id", "part_index").agg(text.alias("content"))
    out = out.select(F.format_string("%s_part_%02d", "session_id", "part_index").alias("session_id"), "part_index", "content")
    if not dry_run:
        out.write.mode("append").parquet(root)
    return out


def write_lines(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Cluster records or proposals as JSON lines, the last run's replaced."""
    if not dry_run:
        df.write.mode("overwrite").json(path)
    return df


def silver_documents(parts: DataFrame) -> DataFrame:
    """Documents of (silver_path, part_index, section): sections in order, parted by one blank line whatever they end with."""
    sep = lambda a: F.when(a == "", "").when(a.endswith("\n\n"), "").when(a.endswith("\n"), "\n").otherwise("\n\n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_index", "section"))), lambda x: x["section"])
    return parts.groupBy("silver_path").agg(ordered.alias("_s")).select("silver_path", F.aggregate("_s", F.lit(""), lambda a, x: F.concat(a, sep(a), x)).alias("text"))
