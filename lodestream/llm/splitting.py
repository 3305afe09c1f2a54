"""Problem 3: oversized sessions and contents cut at natural boundaries, by dynamic programming.

Cut positions are the ends of records (cheapest before a human turn) and, inside a content that alone exceeds
the limit, ends of paragraphs, lines, sentences and words. Among all ways to keep every part, with the
stretch it repeats of the part before, within the limit, the one with the least sum of cut penalties and
squared size imbalance is taken. Sizes are UTF-8 bytes.

Scale: contents are never shuffled, only sizes; a session's prefix sums run per day, and the dynamic programme
per block of ``BLOCK_PARTS`` limits, so that a session with a third of all rows is spread over many tasks
(each block start is one extra cut, at a record's start). Defined results: NULL contents have size 0; rows without
``uuid`` or session are in no session; records at the same instant are ordered by ``uuid``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import prefix_sums
from ..operators.records import event_time, holding, is_human

LIMIT = 20_000
OVERLAP = 400
BLOCK_PARTS = 64
#: Penalty of a cut before a human turn, before another record, and inside a content by the kind of boundary.
HUMAN, RECORD = 0.0, 1.0
PARAGRAPH, LINE, SENTENCE, WORD, ANYWHERE = 0.1, 0.4, 0.8, 1.5, 6.0
#: Inside a content the cheapest boundary of each cell of so many bytes is a candidate.
CELL = 64


def best_cuts(ends: np.ndarray, penalty: np.ndarray, limit: int, overlap: int, begins: bool = True) -> list[int]:
    """Indices of the positions that end a part.

    ``ends`` are rising cumulative sizes; a part from position i to j has ``ends[j] - ends[i]`` new bytes plus, unless it is
    the first of all (``begins``), ``overlap`` repeated ones. A single step that is too large for any part becomes a part of its own.
    """
    n = len(ends)
    if n == 0:
        return []
    cum = np.concatenate([[0], ends]).astype(np.float64)
    room = np.full(n + 1, float(limit - overlap))
    room[0] = float(limit if begins else limit - overlap)
    target = max(1.0, cum[-1] / max(1, np.ceil(cum[-1] / (limit - overlap))))
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    cost[0] = 0.0
    lo = 0
    for j in range(1, n + 1):
        while lo < j - 1 and cum[j] - cum[lo] > room[lo]:
            lo += 1
        size = cum[j] - cum[lo:j]
        c = cost[lo:j] + ((size - target) / target) ** 2 + (penalty[j - 1] if j < n else 0.0)
        c = np.where((size <= room[lo:j]) | (np.arange(lo, j) == j - 1), c, np.inf)
        k = int(np.argmin(c))
        cost[j], back[j] = c[k], lo + k
    cuts, j = [], n
    while j > 0:
        cuts.append(j - 1)
        j = int(back[j])
    return cuts[::-1]


def boundaries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cut positions of a text, each after a boundary, and their penalties; the last is its end."""
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    pen = np.full(n + 1, ANYWHERE)
    pen[:n][(b & 0xC0) == 0x80] = np.inf  # not inside a character
    nl, sp = b == 10, b == 32
    escape = b == 92  # contents are JSON text: a line end may be spelt as a backslash and n
    nl[1:] |= escape[:-1] & (b[1:] == 110)
    pen[1:][sp] = WORD
    if n > 1:
        stop = np.isin(b[:-1], [46, 33, 63]) & (sp[1:] | nl[1:])
        pen[2:][stop] = SENTENCE
    pen[1:][nl] = LINE
    if n > 1:
        pen[2:][nl[:-1] & nl[1:]] = PARAGRAPH
    if n > 2:
        pen[3:][nl[:-2] & escape[1:-1] & nl[2:]] = PARAGRAPH
    pen[1:][escape] = np.inf  # not inside an escape
    cells = np.arange(1, n, CELL)
    at = np.array([s + int(np.argmin(pen[s : min(s + CELL, n)])) for s in cells], dtype=np.int64)
    pen[n] = 0.0
    at = np.unique(np.append(at[np.isfinite(pen[at])], n)) if len(at) else np.array([n])
    return at, pen[at]


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (repeat_from, start, end) byte positions; a piece is ``[repeat_from, end)`` and within the limit."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return [(0, 0, len(raw))]
    at, pen = boundaries(raw)
    out, start = [], 0
    for k in best_cuts(at, pen, limit, overlap):
        back = max(0, start - overlap) if start else 0
        while back < start and raw[back] & 0xC0 == 0x80:
            back += 1
        out.append((back, start, int(at[k])))
        start = int(at[k])
    return out


def pieces(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Single contents over the limit (the version that holds) as numbered text pieces."""
    big = holding(records.where(F.octet_length("msg_content") > limit).select("rec_id", "uuid", "session_id", "loaded_at"))
    held = holding(records.select("rec_id", "uuid", "loaded_at")).select("rec_id")
    text = records.where(F.octet_length("msg_content") > limit).select("rec_id", "msg_content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uuid, sid, text in zip(pdf.uuid, pdf.session_id, pdf.msg_content):
                raw, cuts = text.encode("utf-8", "surrogatepass"), cut_text(text, limit, overlap)
                rows += [(sid, uuid, i + 1, len(cuts), s - r, raw[r:e].decode("utf-8", "replace")) for i, (r, s, e) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["session_id", "uuid", "piece_index", "total_pieces", "overlap_bytes", "piece_text"])

    joined = big.join(held, "rec_id", "left_semi").join(text, "rec_id")
    return joined.select("uuid", "session_id", "msg_content").mapInPandas(
        run, "session_id string, uuid string, piece_index int, total_pieces int, overlap_bytes int, piece_text string"
    )


UNIT = "session_id string, uuid string, rec_id long, rec_no long, human boolean, n_bytes long, session_bytes long, block long, part_in_block int, starts_part boolean, part_bytes long"


def units(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per record of each session over the limit, with the part that the dynamic programme puts it in."""
    sized = records.select(
        "rec_id", "uuid", "session_id", "loaded_at",
        F.coalesce(F.octet_length("msg_content"), F.lit(0)).cast("long").alias("n_bytes"),
        is_human(F.col("rec_type"), F.col("msg_role")).alias("human"),
        event_time(F.col("rec_ts"), F.col("loaded_at")).alias("at"),
    )
    held = holding(sized).where("session_id IS NOT NULL")
    large = held.groupBy("session_id").agg(F.sum("n_bytes").alias("session_bytes")).where(F.col("session_bytes") > limit)
    cum = prefix_sums(
        held.join(large, "session_id"), ["session_id"], F.to_date("at"), [F.col("at"), F.col("uuid")],
        {"_end": F.col("n_bytes"), "rec_no": F.lit(1)},
    )
    block = F.floor((F.col("_end") - F.col("n_bytes")) / F.lit(BLOCK_PARTS * limit))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rec_no", ignore_index=True)
        ends = pdf.n_bytes.to_numpy().cumsum()
        penalty = np.append(np.where(pdf.human.to_numpy()[1:], HUMAN, RECORD), 0.0)
        part = np.zeros(len(pdf), dtype=np.int64)
        for k in best_cuts(ends, penalty, limit, overlap, pdf.rec_no[0] == 1)[:-1]:
            part[k + 1 :] += 1
        pdf["part_in_block"], pdf["starts_part"] = part, np.append(True, part[1:] != part[:-1])
        pdf["part_bytes"] = pdf.groupby("part_in_block").n_bytes.transform("sum")
        return pdf[[c.split()[0] for c in UNIT.split(", ")]]

    return cum.withColumn("block", block).select("session_id", "uuid", "rec_id", "rec_no", "human", "n_bytes", "session_bytes", "block").groupBy("session_id", "block").applyInPandas(run, UNIT)


def _plan(u: DataFrame, limit: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Of the units: one row per part with its number and the length of what it repeats; and the records at the end of each part that the next may repeat.

    A part's number is the number of parts in the blocks before it plus its place in its block: only the counts of a session's blocks are scanned in order,
    and a part meets the one before it by a join on the number, so no task holds a session.
    """
    p = u.groupBy("session_id", "block", "part_in_block").agg(
        F.min("rec_no").alias("first_rec"), F.max("rec_no").alias("last_rec"), F.min_by("uuid", "rec_no").alias("first_uuid"), F.max_by("uuid", "rec_no").alias("last_uuid"),
        F.min_by("human", "rec_no").alias("begins_human"), F.max("part_bytes").alias("new_bytes"),
    )
    w = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = p.groupBy("session_id", "block").agg(F.max("part_in_block").alias("_last")).withColumn("_before", F.coalesce(F.sum(F.col("_last") + 1).over(w), F.lit(0)))
    p = p.join(blocks.select("session_id", "block", "_before"), ["session_id", "block"]).withColumn("part_index", (F.col("_before") + F.col("part_in_block") + 1).cast("int")).drop("_before")
    before = p.select("session_id", (F.col("part_index") + 1).alias("part_index"), F.col("new_bytes").alias("_had"))
    room = F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("new_bytes"))
    p = p.join(before, ["session_id", "part_index"], "left").withColumn("overlap_bytes", F.least(F.lit(overlap).cast("long"), room, F.coalesce("_had", F.lit(0)))).drop("_had")
    back = Window.partitionBy("session_id", "block", "part_in_block").orderBy(F.desc("rec_no"))
    tail = u.withColumn("upto", F.sum("n_bytes").over(back)).where((F.col("n_bytes") > 0) & (F.col("upto") - F.col("n_bytes") < overlap))
    tail = tail.join(p.select("session_id", "block", "part_in_block", (F.col("part_index") + 1).alias("_next")), ["session_id", "block", "part_in_block"])
    return p, tail.select("session_id", F.col("_next").alias("part_index"), "rec_id", "uuid", "rec_no", "upto", "n_bytes")


def parts(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered parts of the sessions over the limit, as the records they hold and the stretch they repeat.

    ``overlap_bytes`` is the length of the end of the part before that the part repeats; it starts at byte ``overlap_from`` of the content of
    record ``overlap_uuid``. A record that leaves less room repeats as much as fits. A part that holds one record over the limit repeats
    nothing and is cut further (as by ``pieces``); ``n_pieces`` says into how many. ``part_texts`` gives the contents.
    """
    p, tail = _plan(units(records, limit, overlap), limit, overlap)
    source = tail.join(p.select("session_id", "part_index", "overlap_bytes"), ["session_id", "part_index"]).where("overlap_bytes > 0 AND upto >= overlap_bytes")
    source = source.groupBy("session_id", "part_index").agg(F.min_by(F.struct("uuid", (F.col("upto") - F.col("overlap_bytes")).alias("at")), "upto").alias("_o"))
    n = pieces(records, limit, overlap).groupBy(F.col("uuid").alias("first_uuid")).agg(F.max("total_pieces").alias("n_pieces"))
    return p.join(source, ["session_id", "part_index"], "left").join(n, "first_uuid", "left").select(
        "session_id", "part_index", "first_uuid", "last_uuid", "begins_human", (F.col("last_rec") - F.col("first_rec") + 1).alias("n_records"),
        "new_bytes", "overlap_bytes", F.col("_o.uuid").alias("overlap_uuid"), F.col("_o.at").alias("overlap_from"), F.coalesce("n_pieces", F.lit(1)).alias("n_pieces"),
    )


def part_texts(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The contents of the parts: (session_id, part_index, piece_index, rec_no, uuid, is_repeat, from_byte, part_text), to be read in the order of the first four.

    Rows of one (part, piece) have ``limit`` bytes at most together. Repeated stretches stand under the records they are from; one that would begin inside a character begins
    behind it. A record over the limit is its own part of several pieces, each with the repeated end of the piece before in its text. Contents are shuffled once, by ``rec_id``.
    """
    u = units(records, limit, overlap)
    p, tail = _plan(u, limit, overlap)
    new = u.join(p.select("session_id", "block", "part_in_block", "part_index"), ["session_id", "block", "part_in_block"]).where("n_bytes > 0")
    new = new.select("session_id", "part_index", "rec_id", "uuid", "rec_no", F.lit(False).alias("is_repeat"), F.lit(0).cast("long").alias("from_byte"))
    again = tail.join(p.select("session_id", "part_index", "overlap_bytes"), ["session_id", "part_index"]).where(F.col("upto") - F.col("n_bytes") < F.col("overlap_bytes"))
    again = again.select("session_id", "part_index", "rec_id", "uuid", "rec_no", F.lit(True).alias("is_repeat"), F.greatest(F.lit(0), F.col("upto") - F.col("overlap_bytes")).cast("long").alias("from_byte"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sid, part, no, uuid, repeat, at, text in zip(pdf.session_id, pdf.part_index, pdf.rec_no, pdf.uuid, pdf.is_repeat, pdf.from_byte, pdf.msg_content):
                raw = text.encode("utf-8", "surrogatepass")
                if repeat:
                    while at < len(raw) and raw[at] & 0xC0 == 0x80:
                        at += 1
                    cuts = [(at, at, len(raw))]
                else:
                    cuts = cut_text(text, limit, overlap)
                rows += [(sid, part, i + 1, no, uuid, repeat, r, raw[r:e].decode("utf-8", "replace")) for i, (r, _, e) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEXTS.split(", ")])

    joined = new.unionByName(again).join(records.select("rec_id", "msg_content"), "rec_id")
    return joined.select("session_id", "part_index", "rec_no", "uuid", "is_repeat", "from_byte", "msg_content").mapInPandas(run, TEXTS)


TEXTS = "session_id string, part_index int, piece_index int, rec_no long, uuid string, is_repeat boolean, from_byte long, part_text string"


def human_turns(records: DataFrame) -> DataFrame:
    """p3_found: the human turns, the preferred boundaries, of each session over the limit."""
    return units(records).where("human").select("session_id", "uuid")
