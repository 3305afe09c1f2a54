"""Schemas that drift between files: rescue-column ingestion.

1. ``ingest`` enforces the target schema line by line: a field under its own name with a castable value is typed; every unknown or uncastable
   field is kept, as JSON, in the ``rescued`` map (key -> JSON text). All later steps read this table, never the raw lines again.
2. ``propose`` examines the rescued paths: which could hold a target field, by the words of their name or because their values agree with the typed
   values of the same session elsewhere. ``approve`` makes the promotion table (field_name, path) of it; a table from a reviewer serves as well.
3. ``replay`` moves the rescued values of approved paths into the typed columns; what they do not hold stays rescued.
4. ``changes`` says where and with which type each file holds each field, typed or rescued, and compares it with the host's previous file.

Names of the given files are written nowhere: a field under a name never seen before is promoted by the same evidence.

Scale: ``ingest`` is narrow; the rescued map is exploded with its keys only; evidence is summed per path, so no group but the counts leaves a task.

Defined results: cut-off lines and lines that are no JSON object, or name a key twice, are unreadable and count for nothing; JSON nulls are no values; of
several places of a field in a line an inner path holds before the field's own name, that before other names (ties: the smallest path); a file's place of a field is the
one most of its lines use (ties: the smallest path), and a host's first file gives no change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Target fields in the order of the consolidated table.
TARGET = ("cwd", "git_branch", "session_started_at", "thread_id")
#: Words (in the name of a path) that can mean the field: the telling words of its own name and their plain synonyms (fixed values).
HEAD = {
    "cwd": ("cwd", "dir", "directory", "folder"),
    "git_branch": ("branch",),
    "session_started_at": ("start", "started", "begin", "began", "begun"),
    "thread_id": ("thread",),
}
KEYS = ("file_name", "host", "file_seq", "line_no")
VARIANTS = "map<string,variant>"


def json_kind(json: Column) -> Column:
    """string, number, array, object, boolean or null of a JSON text."""
    c = F.substring(F.ltrim(json), 1, 1)
    return (
        F.when(c == '"', "string").when(c == "[", "array").when(c == "{", "object").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")
    )


def _members(json: Column) -> Column:
    """Map of an object's keys to the JSON texts of their values; NULL for anything else."""
    return F.transform_values(F.try_parse_json(json).try_cast(VARIANTS), lambda _, v: F.to_json(v))


def _string(json: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(json), "$", "string")


def ingest(lines: DataFrame) -> DataFrame:
    """Enforce the target schema: (keys, session_id, the target fields, rescued). Unreadable lines have no fields and NULL in ``rescued``; other columns are dropped."""
    own = ("session_id", *TARGET)
    read = lines.select(*KEYS, F.transform_values(F.try_parse_json("raw_line").try_cast(VARIANTS), lambda _, v: F.to_json(v)).alias("_m"))
    left = F.map_filter("_m", lambda k, v: (v != "null") & ~(k.isin(*own) & (json_kind(v) == "string")))
    typed = [F.when(json_kind(F.col("_m")[f]) == "string", _string(F.col("_m")[f])).alias(f) for f in own]
    return read.select(*KEYS, *typed, left.alias("rescued"))


def rescued_paths(ingested: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line and rescued path, top level and one level down: (keys, path, parent, json), with the columns to keep. Inner nulls too."""
    cols = [*KEYS, *keep]
    top = ingested.select(*cols, F.explode("rescued").alias("path", "json"))
    inner = top.where(json_kind(F.col("json")) == "object").select(*cols, F.col("path").alias("parent"), F.explode(_members(F.col("json"))).alias("leaf", "json"))
    inner = inner.select(*cols, F.concat_ws(".", "parent", "leaf").alias("path"), "json", "parent")
    return top.withColumn("parent", F.lit("")).unionByName(inner)


def _words(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"), 0), lambda w: F.lower(w))


def named_for(path: Column, parent: Column, field: str) -> Column:
    """Do the words of a path name the field? Inside an object the path does if the object's name alone does not, or lacks a word of the field's that the key has."""
    head, own = F.array(*map(F.lit, HEAD[field])), F.array(*map(F.lit, field.split("_")))
    leaf, up = _words(F.element_at(F.split(path, r"\."), -1)), _words(parent)
    missing = F.array_except(own, F.array_union(up, head))
    return F.when(parent == "", F.arrays_overlap(leaf, head)).otherwise(
        (parent != field) & ((~F.arrays_overlap(up, head) & F.arrays_overlap(leaf, head)) | (F.arrays_overlap(up, head) & F.arrays_overlap(leaf, missing)))
    )


def plain(field: Column, json: Column) -> Column:
    """The text of a value in the field's one type: segments of a path joined, an object's first text, epoch milliseconds as an instant, numbers as digits."""
    kind = json_kind(json)
    segments = F.concat(F.lit("/"), F.array_join(F.from_json(json, "array<string>"), "/"))
    stamp = F.date_format(F.timestamp_millis(json.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(kind == "string", _string(json)).when(kind == "array", segments).when(kind == "object", _string(F.element_at(_members(json), part(json))))
        .when((kind == "number") & (field == "session_started_at"), stamp).otherwise(json)
    )


def part(json: Column) -> Column:
    """The key of an object's first text, in order of the keys."""
    texts = F.map_filter(_members(json), lambda _, v: json_kind(v) == "string")
    return F.array_min(F.map_keys(texts))


def propose(ingested: DataFrame) -> DataFrame:
    """Rescued paths that could hold a target field: (field_name, path, by_name, n_lines, n_known, n_equal, n_beside).

    ``n_known`` counts the lines whose session has the field typed in some line, ``n_equal`` those of them with an equal value,
    ``n_beside`` the lines that have the field under its own name as well: a path that stands beside the field is another field.
    """
    seen = rescued_paths(ingested, ("session_id", *TARGET)).where("json <> 'null'").where(~F.col("path").isin(*TARGET))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), named_for(F.col("path"), F.col("parent"), f).alias("by_name"), F.col(f).isNotNull().alias("beside")) for f in TARGET]))
    seen = seen.select("session_id", "path", "json", each.alias("_f")).select("session_id", "path", "_f.*", plain(F.col("_f.field_name"), F.col("json")).alias("value"))
    typed = ingested.select("session_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in TARGET])).alias("_t")).select("session_id", "_t.*")
    known = typed.where("session_id IS NOT NULL AND value IS NOT NULL").groupBy("session_id", "field_name").agg(F.collect_set("value").alias("known"))
    equal = F.array_contains("known", F.col("value"))
    counts = seen.join(known, ["session_id", "field_name"], "left").groupBy("field_name", "path").agg(
        F.bool_or("by_name").alias("by_name"), F.count("*").alias("n_lines"), F.count_if(F.col("known").isNotNull()).alias("n_known"), F.count_if(equal).alias("n_equal"), F.count_if("beside").alias("n_beside")
    )
    return counts.where((F.col("n_beside") * 2 < F.col("n_lines")) & (F.col("by_name") | (F.col("n_equal") > 0)))


def approve(proposals: DataFrame, support: int = 2, share: float = 0.5) -> DataFrame:
    """The promotion table (field_name, path): each path for one field, by its name, or by at least ``support`` equal values in that share of the known ones."""
    good = proposals.where(F.col("by_name") | ((F.col("n_equal") >= support) & (F.col("n_equal") >= share * F.col("n_known"))))
    order = F.struct(~F.col("by_name"), -F.col("n_equal"), "field_name")
    best = good.groupBy("path").agg(F.min_by("field_name", order).alias("field_name"), F.min_by("by_name", order).alias("by_name")).select("field_name", "path", "by_name")
    # a key's value may agree only because its object gives the same text: the object is the place unless the key's name says otherwise
    itself = best.sparkSession.createDataFrame([(f, f) for f in TARGET], "field_name string, _root string")
    root, inside = F.substring_index("path", ".", 1), F.col("path").contains(".")
    named = best.where(inside & F.col("by_name")).select("field_name", root.alias("path")).distinct()
    top = best.where(~inside & F.col("by_name")).unionByName(best.where(~inside & ~F.col("by_name")).join(named, ["field_name", "path"], "left_anti")).select("field_name", "path")
    objects = top.select("field_name", F.col("path").alias("_root")).unionByName(itself)
    inner = best.where(inside & ~F.col("by_name")).withColumn("_root", root).join(objects, ["field_name", "_root"], "left_anti").select("field_name", "path")
    return top.unionByName(best.where(inside & F.col("by_name")).select("field_name", "path")).unionByName(inner)


def promotion(ingested: DataFrame) -> DataFrame:
    """The promotion table of every good proposal; the proposals, a row per path, are written once."""
    return approve(materialize(propose(ingested), "proposals"))


def placed(ingested: DataFrame, approved: DataFrame) -> DataFrame:
    """The place of each target field in each line: (keys, field_name, path, json); typed values stand under the field's own name."""
    own = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in TARGET]))
    typed = ingested.select(*KEYS, F.explode(own).alias("field_name")).withColumns({"path": F.col("field_name"), "json": F.lit('""'), "rank": F.lit(1)})
    itself = ingested.sparkSession.createDataFrame([(f, f) for f in TARGET], "field_name string, path string")
    rank = F.when(F.col("path").contains("."), 0).when(F.col("path") == F.col("field_name"), 1).otherwise(2)
    other = rescued_paths(ingested).join(approved.select("field_name", "path").unionByName(itself).distinct(), "path").select(*KEYS, "field_name", "path", "json", rank.alias("rank"))
    best = typed.unionByName(other).groupBy(*KEYS, "field_name").agg(F.min_by(F.struct("path", "json"), F.struct("rank", "path")).alias("v"))
    return best.select(*KEYS, "field_name", "v.*").where("json <> 'null'")


def changes(ingested: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """p7: the change of each target field from the host's previous file to this one; without ``approved`` every good proposal counts."""
    approved = promotion(ingested) if approved is None else approved
    files = ingested.select("file_name", "host", "file_seq").distinct()
    counted = placed(ingested, approved).groupBy("file_name", "host", "file_seq", "field_name", "path", json_kind(F.col("json")).alias("kind")).agg(F.count("*").alias("n"))
    place = counted.groupBy("file_name", "host", "file_seq", "field_name").agg(F.min_by(F.struct("path", "kind"), F.struct(-F.col("n"), "path", "kind")).alias("v"))
    grid = files.withColumn("field_name", F.explode(F.array(*map(F.lit, TARGET))))
    w = Window.partitionBy("host", "field_name").orderBy("file_seq", "file_name")
    seen = (
        grid.join(place.select("file_name", "host", "file_seq", "field_name", "v.*"), ["file_name", "host", "file_seq", "field_name"], "left")
        .withColumn("_first", F.row_number().over(w) == 1)
        .withColumns({"old_path": F.lag("path").over(w), "old_kind": F.lag("kind").over(w)})
        .where("NOT _first")
    )
    both = F.col("path").isNotNull() & F.col("old_path").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(F.col("old_path").isNull() & F.col("path").isNotNull(), "added"),
            F.when(F.col("path").isNull() & F.col("old_path").isNotNull(), "removed"),
            F.when(both & (F.col("path") != F.col("old_path")), "renamed"),
            F.when(both & (F.col("kind") != F.col("old_kind")), "retyped"),
        )
    )
    return seen.select("file_name", "field_name", F.explode(kinds).alias("change_kind"))


def replay(ingested: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """The consolidated table: rescued values of approved paths cast into the typed columns, one name and type each.

    Arrays of path segments become a path, objects give their first text, and numbers in ``session_started_at`` are epoch milliseconds; a numeric thread
    id is its decimal text. What was not moved stays in ``rescued``, also the other keys of an object that gave a value.
    """
    approved = promotion(ingested) if approved is None else approved
    moved = placed(ingested, approved).where(F.col("json") != '""').withColumn("value", plain(F.col("field_name"), F.col("json"))).where("value IS NOT NULL")
    taken = F.when(json_kind(F.col("json")) == "object", F.concat_ws(".", "path", part(F.col("json")))).otherwise(F.col("path"))
    wide = moved.withColumn("_taken", taken).groupBy(*KEYS).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f"new_{f}") for f in TARGET], F.collect_set("_taken").alias("_taken"))
    gone = F.coalesce("_taken", F.array().cast("array<string>"))

    def rest(k: Column, v: Column) -> Column:
        """A rescued value without the keys that were moved (two levels)."""
        inside = F.map_filter(F.try_parse_json(v).try_cast(VARIANTS), lambda k2, _: ~F.array_contains(gone, F.concat_ws(".", k, k2)))
        touched = F.exists(gone, lambda g: g.startswith(F.concat(k, F.lit("."))))
        return F.when(touched & (json_kind(v) == "object"), F.nullif(F.to_json(inside), F.lit("{}"))).otherwise(v)

    left = F.map_filter(F.transform_values(F.map_filter("rescued", lambda k, _: ~F.array_contains(gone, k)), rest), lambda _, v: v.isNotNull())
    return ingested.where("rescued IS NOT NULL").join(wide, list(KEYS), "left").select(*KEYS, "session_id", *[F.coalesce(f, f"new_{f}").alias(f) for f in TARGET], left.alias("rescued"))
