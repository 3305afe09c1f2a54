"""Frontmatter of Markdown documents: reading, rendering and rewriting, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "---"


def head(text: Column) -> Column:
    """Lines between the fences; NULL if the text does not begin with a fence or the fence is not closed."""
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), FENCE)
    return F.when((F.trim(lines[0]) == FENCE) & (end > 0), F.slice(lines, F.lit(2), (end - 1).cast("int")))


def body(text: Column) -> Column:
    """Text after the closing fence without leading line ends; the whole text if there is no frontmatter."""
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), FENCE)
    rest = F.array_join(F.slice(lines, (end + 2).cast("int"), F.greatest(F.size(lines) - 1 - end, F.lit(0)).cast("int")), "\n")
    return F.when((F.trim(lines[0]) == FENCE) & (end > 0), F.regexp_replace(rest, r"^\n+", "")).otherwise(text)


def pairs(text: Column) -> Column:
    """Map of the keys to their raw values; the last of repeated keys holds, lines without a colon are skipped."""
    kv = F.transform(F.filter(head(text), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(kv, lambda p, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def scalar(value: Column) -> Column:
    """A scalar; the word ``null`` and an empty value are NULL."""
    return F.nullif(F.nullif(value, F.lit("null")), F.lit(""))


def items(value: Column) -> Column:
    """A bracketed list: split at commas, outer quotes and blanks dropped, empty items dropped."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def render_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def render(value: Column) -> Column:
    """A scalar in its spelling; NULL is ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def rewrite_all(text: Column, values: dict[str, Column]) -> Column:
    """Replace the values of keys in place, or add keys at the end of the frontmatter, in the given order; other lines and the body stay. A NULL value changes nothing."""
    h = head(text)
    new = {k: F.concat(F.lit(f"{k}: "), v) for k, v in values.items()}

    def line(x: Column) -> Column:
        out = x
        for k, v in new.items():
            out = F.when(x.startswith(f"{k}:") & v.isNotNull(), v).otherwise(out)
        return out

    there = lambda k: F.exists(h, lambda x: x.startswith(f"{k}:"))
    added = F.array_compact(F.array(*[F.when(~there(k), v) for k, v in new.items()]))
    lines = F.concat(F.transform(h, line), added)
    return F.when(h.isNull(), text).otherwise(F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body(text)))


def rewrite(text: Column, key: str, value: Column) -> Column:
    """Replace the value of a key in place, or add the key at the end of the frontmatter; other lines and the body stay."""
    return rewrite_all(text, {key: value})


def title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, else the fallback."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")), fallback)
