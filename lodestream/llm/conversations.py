"""Problem 4: conversations rebuilt from message rows by keyed streaming state.

A Structured Streaming query keeps, per session and day, the records seen so far in state, one entry per ``uuid``
(the version loaded last holds), so late and re-delivered rows find their place. When the event-time watermark passes the
end of the day plus the allowed lateness, or the bounded backlog is closed, the segment is emitted: its records in
time order with their roles, and a summary. Segments of a session are then joined in order; a session with a third of all
rows is one small segment per day and never one task.

The state holds record facts (ids, times, flags, tool ids), never texts. Rows later than the watermark allows
would be dropped by the state operator, so a backlog is read as one micro-batch before any timeout fires, and
``lateness`` is the parameter that a continuous run has to set beyond its worst delay.

Defined results: rows without session belong to no conversation; a session of rows without ``uuid`` or content is
``empty``; unreadable JSON is content without tool ids; ties of time are ordered by ``uuid``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import blocks, event_time, is_assistant, is_blank, is_human
from ..session import shared_path

LATENESS = "30 days"
DAY_MS = 86_400_000
FACTS = "session_id string, day date, at timestamp, uuid string, loaded_us long, rec_id long, kind string, calls array<string>, results array<string>"
STATE = "uuid array<string>, at_us array<long>, loaded_us array<long>, rec_id array<long>, kind array<string>, calls array<string>, results array<string>"
OUT = (
    "session_id string, day date, n_content int, n_human int, n_assistant int, first_kind string, lead_reply boolean, torn boolean, pending boolean, "
    "uuids array<string>, ats array<timestamp>, kinds array<string>, call_ids array<string>, call_ats array<timestamp>, open_ids array<string>, open_ats array<timestamp>"
)
SEP = "\x1f"


def facts(records: DataFrame) -> DataFrame:
    """Per row what the state needs: kind is human, assistant, other, or blank (no content); extra columns are ignored."""
    parsed = records.where("session_id IS NOT NULL").withColumn("_b", blocks(F.col("msg_content")))
    kind = (
        F.when(F.col("uuid").isNull() | is_blank(F.col("msg_content"), F.col("_b")), "blank")
        .when(is_human(F.col("rec_type"), F.col("msg_role")), "human")
        .when(is_assistant(F.col("rec_type")), "assistant")
        .otherwise("other")
    )
    ids = lambda t, c: F.array_compact(F.transform(F.filter(F.coalesce("_b", F.array()), lambda b: b["type"] == t), lambda b: b[c]))
    at = event_time(F.col("rec_ts"), F.col("loaded_at"))
    return parsed.select(
        "session_id", F.to_date(at).alias("day"), at.alias("at"), F.coalesce("uuid", F.concat(F.lit("~"), "rec_id")).alias("uuid"),
        F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"), "rec_id", kind.alias("kind"),
        ids("tool_use", "id").alias("calls"), ids("tool_result", "tool_use_id").alias("results"),
    )


def _summary(key: tuple, s: dict) -> pd.DataFrame:
    """The emitted row of a segment from its state columns."""
    order = sorted((i for i in range(len(s["uuid"])) if s["kind"][i] != "blank"), key=lambda i: (s["at_us"][i], s["uuid"][i]))
    kinds = [s["kind"][i] for i in order]
    lead = torn = pending = False
    seen_human = False
    called: dict[str, int] = {}
    open_: list[tuple[str, int]] = []
    for i, k in zip(order, kinds):
        torn |= k == "human" and pending
        lead |= k == "assistant" and not seen_human
        seen_human |= k == "human"
        pending = k == "human" or (pending and k != "assistant")
        open_ += [(x, s["at_us"][i]) for x in s["results"][i].split(SEP) if x and x not in called]
        for x in s["calls"][i].split(SEP):
            if x:
                called.setdefault(x, s["at_us"][i])
    ts = lambda us: pd.Timestamp(us, unit="us").to_pydatetime()
    row = {
        "session_id": key[0], "day": key[1], "n_content": len(order), "n_human": kinds.count("human"), "n_assistant": kinds.count("assistant"),
        "first_kind": kinds[0] if kinds else None, "lead_reply": lead, "torn": torn, "pending": pending,
        "uuids": [s["uuid"][i] for i in order], "ats": [ts(s["at_us"][i]) for i in order], "kinds": kinds,
        "call_ids": list(called), "call_ats": [ts(x) for x in called.values()], "open_ids": [x for x, _ in open_], "open_ats": [ts(x) for _, x in open_],
    }
    return pd.DataFrame([row])


def _segment(late_ms: int):
    names = [c.split()[0] for c in STATE.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(names, map(list, state.get))) if state.exists else {n: [] for n in names}
        if state.hasTimedOut:
            state.remove()
            yield _summary(key, held)
            return
        place = {u: i for i, u in enumerate(held["uuid"])}
        for pdf in batches:
            at_us = pdf["at"].astype("datetime64[us]").astype("int64") if pdf["at"].dt.tz is None else pdf["at"].dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64")
            for u, at, lo, rid, kind, calls, results in zip(pdf.uuid, at_us, pdf.loaded_us, pdf.rec_id, pdf.kind, pdf.calls, pdf.results):
                new = (u, int(at), int(lo), int(rid), kind, SEP.join(calls), SEP.join(results))
                i = place.get(u)
                if i is None:
                    place[u] = len(held["uuid"])
                    for n, v in zip(names, new):
                        held[n].append(v)
                elif new[2:4] > (held["loaded_us"][i], held["rec_id"][i]):
                    for n, v in zip(names, new):
                        held[n][i] = v
        state.update(tuple(held[n] for n in names))
        end = int(pd.Timestamp(key[1]).timestamp() * 1000) + DAY_MS + late_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        return
        yield

    return update


def run_stream(source: DataFrame, root: str, lateness: str = LATENESS) -> None:
    """Run the stateful query over all that is there (``availableNow``) and append emitted segments to ``root/out``."""
    late_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    keyed = source.withWatermark("at", lateness).groupBy("session_id", "day")
    out = keyed.applyInPandasWithState(_segment(late_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def segments(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """All segments of a bounded backlog at ``path``.

    Beside the records the stream reads a folder with one closing row, whose event time lies far ahead: the watermark
    it sets lets every timeout fire, so that each buffered segment is emitted.
    """
    root = shared_path(spark, "conversations")
    rows = facts(spark.read.parquet(path))
    if rows.isEmpty():
        return spark.createDataFrame([], OUT)
    rows.limit(0).write.parquet(f"{root}/closing")  # the folder with its schema
    last = rows.agg(F.max("at").alias("at")).where("at IS NOT NULL")
    closing = last.select((F.col("at") + F.expr(f"INTERVAL {lateness}") * 2 + F.expr("INTERVAL 2 DAYS")).alias("at"))
    none = F.array().cast("array<string>")
    filled = {"session_id": F.lit(None).cast("string"), "day": F.to_date("at"), "at": F.col("at"), "uuid": F.lit("closing"), "loaded_us": F.lit(0).cast("long"), "rec_id": F.lit(0).cast("long"), "kind": F.lit("blank"), "calls": none, "results": none}
    closing.select(*[c.alias(n) for n, c in filled.items()]).write.mode("append").parquet(f"{root}/closing")
    anywhere = path[:-1] + f"[{path[-1]}]"  # a pattern: the stream then takes a folder or a single file
    stream = facts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(anywhere))
    close = spark.readStream.schema(FACTS).parquet(f"{root}/closing")
    run_stream(stream.unionByName(close), root, lateness)
    return spark.read.schema(OUT).parquet(f"{root}/out").where("session_id IS NOT NULL")


def conversations(segs: DataFrame) -> DataFrame:
    """The records of each session in order, with speaker roles; whole sessions, also those to be dropped."""
    before = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offset = segs.withColumn("_base", F.coalesce(F.sum("n_content").over(before), F.lit(0)))
    each = F.posexplode(F.arrays_zip("uuids", "ats", "kinds"))
    return offset.select("session_id", "_base", each).select(
        "session_id", (F.col("_base") + F.col("pos") + 1).alias("turn_no"), F.col("col.uuids").alias("uuid"), F.col("col.ats").alias("at"),
        F.when(F.col("col.kinds") == "human", "user").when(F.col("col.kinds") == "assistant", "assistant").otherwise("tool").alias("speaker"),
    )


def rejected(segs: DataFrame) -> DataFrame:
    """p4_found: sessions that are dropped, with the first reason that applies."""
    calls = segs.select("session_id", F.explode(F.arrays_zip("call_ids", "call_ats")).alias("c")).groupBy("session_id", F.col("c.call_ids").alias("id")).agg(F.min("c.call_ats").alias("called"))
    open_ = segs.select("session_id", F.explode(F.arrays_zip("open_ids", "open_ats")).alias("o")).select("session_id", F.col("o.open_ids").alias("id"), F.col("o.open_ats").alias("used"))
    dangling = open_.join(calls, ["session_id", "id"], "left").where("called IS NULL OR called >= used").select("session_id").distinct().withColumn("dangling", F.lit(True))
    w = Window.partitionBy("session_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    spoken = segs.where("n_human + n_assistant > 0")
    nxt = spoken.withColumn("_next_leads", F.first(F.when(F.col("n_human") + F.col("n_assistant") > 0, F.col("lead_reply")), True).over(w))
    reply = nxt.groupBy("session_id").agg(F.max(F.col("torn") | (F.col("pending") & ~F.coalesce("_next_leads", F.lit(False)))).alias("no_reply"))
    some = segs.groupBy("session_id").agg(
        F.sum("n_content").alias("n_content"), F.sum(F.col("n_human") + F.col("n_assistant")).alias("n_spoken"),
        F.min_by("first_kind", F.when(F.col("n_content") > 0, F.col("day"))).alias("first_kind"),
    )
    joined = some.join(dangling, "session_id", "left").join(reply, "session_id", "left")
    reason = (
        F.when((F.col("n_content") == 0) | (F.col("n_spoken") == 0), "empty")
        .when((F.col("first_kind") != "human") | F.coalesce("dangling", F.lit(False)), "broken")
        .when(F.coalesce("no_reply", F.lit(False)), "no_reply")
    )
    return joined.select("session_id", reason.alias("reason")).where("reason IS NOT NULL")


def kept(segs: DataFrame) -> DataFrame:
    """The ordered conversations without the rejected sessions."""
    return conversations(segs).join(rejected(segs).select("session_id"), "session_id", "left_anti")
