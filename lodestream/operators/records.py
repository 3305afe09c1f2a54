"""Transcript records: event time, roles, the version that holds, and block facts.

A record is a row with a ``uuid``. Re-delivered rows and earlier, incomplete versions share it; the row
with the latest ``loaded_at`` (ties: the largest ``rec_id``) holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block fields that the conversation and linking operators need; other keys are not parsed.
BLOCKS = "array<struct<type:string,text:string,id:string,tool_use_id:string>>"


def event_time(rec_ts: Column, fallback: Column | None = None) -> Column:
    """Instant of a record from ISO-8601 (any offset, ``T`` or blank) or epoch milliseconds; else ``fallback``."""
    text = F.trim(rec_ts)
    parsed = F.when(text.rlike(r"^\d{11,14}$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(
        text.try_cast("timestamp")
    )
    return F.coalesce(parsed, fallback.cast("timestamp")) if fallback is not None else parsed


def role(msg_role: Column) -> Column:
    """Role in one spelling; a missing or blank role is NULL."""
    return F.nullif(F.lower(F.trim(msg_role)), F.lit(""))


def is_human(rec_type: Column, msg_role: Column) -> Column:
    """Human turn: type ``user`` with the role user or no role."""
    return (F.coalesce(rec_type, F.lit("")) == "user") & (F.coalesce(role(msg_role), F.lit("user")) == "user")


def is_assistant(rec_type: Column) -> Column:
    return F.coalesce(rec_type, F.lit("")) == "assistant"


def blocks(msg_content: Column) -> Column:
    """The block array of a content, NULL for strings and unreadable JSON."""
    return F.when(F.ltrim(msg_content).startswith("["), F.from_json(msg_content, BLOCKS))


def is_blank(msg_content: Column, parsed: Column) -> Column:
    """NULL, a blank JSON string, an empty array, or an array of nothing but blank text blocks."""
    return (
        msg_content.isNull()
        | msg_content.rlike(r'^\s*("(\s|\\[ntrfb]|\\u00[02a]0)*"|\[\s*\]|null)?\s*$')
        | F.coalesce(
            F.forall(parsed, lambda b: (F.coalesce(b["type"], F.lit("")) == "text") & (F.trim(F.regexp_replace(F.coalesce(b["text"], F.lit("")), r"\s+", " ")) == "")),
            F.lit(False),
        )
    )


def holding(records: DataFrame) -> DataFrame:
    """Keep the version that holds of each ``uuid``.

    Project to the columns needed before calling: whatever the frame carries is shuffled by ``uuid``.
    Rows without ``uuid`` are not records and are left out.
    """
    w = Window.partitionBy("uuid").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("rec_id").desc())
    return records.where("uuid IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
