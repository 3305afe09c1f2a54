"""Extraction: groups of parts, completeness, entry blocks, owned fields and id collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm

#: Keys an entry must have (fixed values); a summary is optional.
REQUIRED = ("id", "type", "topics", "projects", "agents", "staleness_policy")
START, END, NOTHING = "===ENTRY START===", "===ENTRY END===", "NO_NEW_KNOWLEDGE"


def extract_groups(manifest: DataFrame) -> DataFrame:
    """One group per silver document that is to be extracted: its canonical row (last part) and its siblings, which share the result."""
    m = manifest.where("status = 'silver' AND coalesce(silver_path, '') <> ''")
    order = F.struct(F.coalesce("part_index", F.lit(0)), "session_id")
    return m.groupBy("silver_path").agg(F.max_by("session_id", order).alias("canonical"), F.count("*").alias("n_parts"), F.max(F.coalesce("part_index", F.lit(0))).alias("last_part"))


def propagate(manifest: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """Manifest updates after extraction: every row of a group takes the result of its canonical row (silver_path, gold_paths): (session_id, status, extracted_at, gold_paths, error)."""
    group = manifest.where("status = 'silver' AND coalesce(silver_path, '') <> ''").select("session_id", "silver_path")
    return group.join(results.select("silver_path", "gold_paths"), "silver_path").select("session_id", F.lit("gold").alias("status"), F.lit(at).alias("extracted_at"), "gold_paths", F.lit(None).cast("string").alias("error"))


#: Keys of an entry's frontmatter, in order, with the columns they are from (fixed values).
ENTRY_KEYS = (
    ("id", "id"), ("type", "entry_type"), ("topics", "topics"), ("projects", "projects"), ("agents", "agents"), ("staleness_policy", "staleness_policy"), ("source_sessions", "source_sessions"), ("created", "created"),
    ("last_validated", "last_validated"), ("last_queried", "last_queried"), ("query_count", "query_count"), ("confidence", "confidence"), ("supersedes", "supersedes"), ("thread_id", "thread_id"),
)


def entry_documents(gold: DataFrame) -> DataFrame:
    """(entry_no, name, text): the Markdown document of each entry, frontmatter, blank line and body."""
    lists = {f.name for f in gold.schema.fields if f.dataType.typeName() == "array"}
    rows = [F.concat(F.lit(f"{k}: "), fm.render_list(F.coalesce(c, F.array().cast("array<string>"))) if c in lists else fm.render(F.col(c))) for k, c in ENTRY_KEYS]
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    return gold.select("entry_no", F.col("id").alias("name"), F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n\n"), body, F.lit("\n")).alias("text"))


def parse_entries(docs: DataFrame) -> DataFrame:
    """What a search and the clustering need of entry documents (name, text): (name, id, title, entry_type, topics, agents, thread_id, body). The id falls back to the file's name, the title to the id."""
    d = docs.select("name", fm.pairs(F.col("text")).alias("kv"), fm.body(F.col("text")).alias("body"))
    get = lambda k: fm.scalar(F.element_at("kv", k))
    ident = F.coalesce(get("id"), F.col("name"))
    return d.select(
        "name", ident.alias("id"), fm.title(F.col("body"), ident).alias("title"), get("type").alias("entry_type"), fm.items(F.element_at("kv", "topics")).alias("topics"),
        fm.items(F.element_at("kv", "agents")).alias("agents"), get("thread_id").alias("thread_id"), "body",
    )


def visible(gold: DataFrame) -> DataFrame:
    """The first row of each id that no entry supersedes: what a search may return."""
    retired = gold.select(F.explode("supersedes").alias("id")).where("id <> ''").distinct()
    return first_rows(gold).join(retired, "id", "left_anti")


def arrived_since(gold: DataFrame, mark: int | None) -> DataFrame:
    """Entries of batches after the mark of the last run; all without a mark."""
    return gold if mark is None else gold.where(F.col("batch_no") > mark)


def recoverable() -> Column:
    """Extracted without entries; a missing list is not recoverable."""
    return (F.col("status") == "gold") & F.col("gold_paths").isNotNull() & (F.size("gold_paths") == 0)


def stuck(manifest: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Rows extracted without entries within the last hours; an unreadable time is ignored."""
    at = F.expr("try_cast(extracted_at AS TIMESTAMP)")
    return manifest.where(recoverable() & (at > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))).agg(F.count("*").alias("n_stuck"))


def entries_of(docs: DataFrame) -> DataFrame:
    """Documents that begin with frontmatter, their keys and body."""
    return docs.where(F.col("text").startswith("---\n")).select("doc_id", fm.pairs(F.col("text")).alias("kv"), fm.body(F.col("text")).alias("body"), "text").where("kv IS NOT NULL")


def completeness(docs: DataFrame) -> DataFrame:
    """Missing required keys of each entry; presence counts, not content."""
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("kv"))
    return entries_of(docs).select("doc_id", F.array_join(F.array_sort(missing), ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def as_block(gold: DataFrame) -> DataFrame:
    """Entries in the form of a model's answer, two ways: a block each, or the statement that there is nothing new."""
    c = F.col
    text = F.concat(
        F.lit(START + "\n---\nid: "), F.coalesce("id", F.lit("")), F.lit("\ntype: "), c("entry_type"), F.lit("\ntopics: "), fm.render_list(c("topics")), F.lit("\nquery_count: "), fm.render(c("query_count")),
        F.lit("\n---\n"), F.coalesce("summary", F.lit(NOTHING)), F.lit("\n" + END),
    )
    return gold.select("entry_no", text.alias("answer"))


def split_answer(answers: DataFrame) -> DataFrame:
    """Entries of an answer. The statement of nothing new anywhere empties it; blocks without end, id or type are dropped."""
    a = answers.where(~F.col("answer").contains(NOTHING)).select("entry_no", F.explode(F.slice(F.split("answer", START), 2, 1_000_000)).alias("b")).where(F.col("b").contains(END))
    block = F.trim(F.regexp_replace(F.substring_index("b", END, 1), r"^\n+|\n+$", ""))
    a = a.select("entry_no", block.alias("block")).withColumns({"kv": fm.pairs(F.col("block")), "body": fm.body(F.col("block"))})
    get = lambda k: F.nullif(F.element_at("kv", k), F.lit(""))
    out = a.select("entry_no", get("id").alias("id"), get("type").alias("entry_type"), F.array_join(fm.items(get("topics")), "|").alias("topics"), F.expr("try_cast(element_at(kv, 'query_count') AS BIGINT)").alias("query_count"), F.trim("body").alias("body"))
    return out.where("id IS NOT NULL AND entry_type IS NOT NULL")


def owned_fields(gold: DataFrame, today: str) -> DataFrame:
    """Fields that the pipeline owns override those of the model; a project other than unknown wins, ``supersedes`` stays if given."""
    project = F.element_at("projects", 1)
    return gold.select(
        "entry_no", F.array_join(F.slice("source_sessions", 1, 1), "|").alias("source_sessions"),
        F.when((F.size("projects") > 0) & (project != "unknown"), project).otherwise(F.array_join("projects", "|")).alias("projects"),
        F.lit(today).alias("created"), F.lit(today).alias("last_validated"), F.lit(0).cast("long").alias("query_count"), F.lit("medium").alias("confidence"),
        F.array_join(F.coalesce("supersedes", F.array().cast("array<string>")), "|").alias("supersedes"), F.nullif("thread_id", F.lit("null")).alias("thread_id"),
    )


def prompt_meta(manifest: DataFrame) -> DataFrame:
    """Metadata lines of an extraction prompt: only what is there, and not the word null; the project falls back to the encoded directory."""
    line = lambda k, c: F.when(F.coalesce(c, F.lit("")).isin("", "null"), None).otherwise(F.concat(F.lit(f"{k}: "), c))
    keys = [("session_id", F.col("session_id")), ("project", F.coalesce("project", "project_hash")), ("agent", F.col("agent")), ("cwd", F.col("cwd")), ("git_branch", F.col("git_branch")), ("thread_id", F.col("thread_id"))]
    return manifest.where("status = 'silver'").select("session_id", F.concat_ws("\n", *[line(k, c) for k, c in keys]).alias("meta"))


def id_collisions(gold: DataFrame) -> DataFrame:
    """Rows whose exact id an earlier row has; the first one is the writer."""
    first = gold.where("id IS NOT NULL").groupBy("id").agg(F.min("entry_no").alias("first_no"))
    return gold.select("entry_no", "id").join(first, "id").where("entry_no > first_no").select("entry_no", "id", "first_no")


def query_text(gold: DataFrame, cap: int = 3000) -> DataFrame:
    """One line per entry to search with: title, topics, type, agents, and the summary or the start of the body."""
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.trim(F.regexp_replace(F.substring("body", 1, cap), r"\s+", " ")))
    parts = [fm.title(F.col("body"), F.col("id")), F.array_join("topics", " "), F.col("entry_type"), F.array_join("agents", " "), text]
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return gold.select("entry_no", F.regexp_replace(joined, r"\s+", " ").alias("query_text"))


def first_rows(gold: DataFrame) -> DataFrame:
    """One row per exact id, the one that arrived first."""
    w = Window.partitionBy("id").orderBy("entry_no")
    return gold.where("id IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
