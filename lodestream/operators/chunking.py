"""Human-turn-aligned balanced splitting of sessions (the batch pipeline's splitter).

``total`` bytes of a session (one line end per row included) are cut into at most ``ceil(total / soft)`` parts: a part ends once it has
``total div parts`` bytes and a human turn follows. Rows are first summed to turns, so that only numbers are moved, never contents.

A session of at most ``FOLD_TURNS`` turns is one fold over its turns, a group of bounded size. A longer one, such as a resident agent with
a third of all rows, never is a group: for every turn the next cut is found among the turns near its target byte (groups bounded by the
target), and the cuts that the first turn leads to are reached by doubling these steps, in as many rounds as the part count has bits.
Both ways give the same parts. Defined results: rows without session are left out, an oversized single turn stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import prefix_sums
from .records import is_human

FOLD_TURNS = 20_000


def lines(transcripts: DataFrame) -> DataFrame:
    """Rows as lines of their session, in order of delivery: (session_id, rec_id, n_bytes, human, turn_no, line_no, end_byte)."""
    base = transcripts.where("session_id IS NOT NULL").select(
        "session_id", "rec_id", "loaded_at", (F.coalesce(F.octet_length("msg_content"), F.lit(0)) + 1).cast("long").alias("n_bytes"),
        is_human(F.col("rec_type"), F.col("msg_role")).alias("human"),
    )
    return prefix_sums(base, ["session_id"], F.to_date("loaded_at"), [F.col("rec_id")], {"turn_no": F.col("human").cast("long"), "line_no": F.lit(1), "end_byte": F.col("n_bytes")})


def _folded(turns: DataFrame) -> DataFrame:
    """Parts of sessions of few turns: (session_id, part_index, first_rec, last_rec, part_bytes)."""
    per = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "b", "first", "last"))).alias("turns"), F.first("target").alias("_target"), F.first("parts").alias("_parts"))
    # State: the parts that are closed and the open one, so that no turn is looked at again.
    row = "struct<first_rec:bigint,last_rec:bigint,part_bytes:bigint>"
    none = F.lit(None).cast("long")
    state = F.struct(F.lit(0).cast("long").alias("cur"), none.alias("first"), none.alias("last"), F.array().cast(f"array<{row}>").alias("closed"))
    ended = lambda s: F.struct(s["first"].alias("first_rec"), s["last"].alias("last_rec"), s["cur"].alias("part_bytes")).cast(row)

    def fold(s, t):
        cut = (s["cur"] >= F.col("_target")) & (F.size(s["closed"]) + 1 < F.col("_parts"))
        return F.struct(
            (F.when(cut, F.lit(0)).otherwise(s["cur"]) + t["b"]).cast("long").alias("cur"), F.when(cut, t["first"]).otherwise(F.least(s["first"], t["first"])).alias("first"),
            F.when(cut, t["last"]).otherwise(F.greatest(s["last"], t["last"])).alias("last"), F.when(cut, F.array_append(s["closed"], ended(s))).otherwise(s["closed"]).alias("closed"),
        )

    parts = per.select("session_id", F.posexplode(F.aggregate("turns", state, fold, lambda s: F.array_append(s["closed"], ended(s)))))
    return parts.select("session_id", (F.col("pos") + 1).cast("long").alias("part_index"), "col.*")


def _next_cuts(turns: DataFrame) -> DataFrame:
    """(session_id, start, nxt): the start bytes of each turn and of the first turn that begins at least a target later, if there is one.

    A turn's end is the start of the turn after it. It is filed in every stretch of one target's length from the turn's start to its end, so
    that the stretch of a sought byte always holds the first start at or after it, however long a turn is.
    """
    cell = lambda c: F.floor(c / F.col("target"))
    ends = turns.where("start + b < total").select("session_id", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("b")))).alias("cell"), (F.col("start") + F.col("b")).alias("at"), F.lit(None).cast("long").alias("start"))
    sought = turns.select("session_id", cell(F.col("start") + F.col("target")).alias("cell"), (F.col("start") + F.col("target")).alias("at"), "start")
    # At the same byte the sought comes first, so the start that lies exactly there counts.
    w = Window.partitionBy("session_id", "cell").orderBy("at", F.col("start").isNull()).rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("start").isNull(), F.col("at")), ignorenulls=True).over(w)
    return ends.unionByName(sought).withColumn("nxt", nxt).where("start IS NOT NULL AND nxt IS NOT NULL").select("session_id", "start", "nxt")


def _doubled(turns: DataFrame) -> DataFrame:
    """Parts of sessions of many turns, as ``_folded`` gives them, without a group per session."""
    most = turns.agg(F.max("parts")).first()[0] or 1
    limits = turns.where("start = 0").select("session_id", "parts", "target", "total")
    step, jump = 1, materialize(_next_cuts(turns), "jump")
    cuts = limits.select("session_id", F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("part_index"))
    while True:
        ahead = cuts.join(jump, ["session_id", "start"]).select("session_id", F.col("nxt").alias("start"), (F.col("part_index") + step).alias("part_index"))
        cuts = materialize(cuts.unionByName(ahead), "cuts")
        step *= 2
        if step >= most:
            break
        further = jump.select("session_id", F.col("start").alias("nxt"), F.col("nxt").alias("then"))
        jump = materialize(jump.join(further, ["session_id", "nxt"]).select("session_id", "start", F.col("then").alias("nxt")), "jump")
    cuts = cuts.join(limits, "session_id").where("part_index <= parts")
    until = cuts.select("session_id", (F.col("part_index") - 1).alias("part_index"), F.col("start").alias("until"))
    ranges = cuts.join(until, ["session_id", "part_index"], "left").withColumn("until", F.coalesce("until", "total"))
    cells = F.sequence(F.floor(F.col("start") / F.col("target")), F.floor((F.col("until") - 1) / F.col("target")))
    ranges = ranges.select("session_id", "part_index", F.col("start").alias("_from"), "until", F.explode(cells).alias("cell"))
    placed = turns.withColumn("cell", F.floor(F.col("start") / F.col("target"))).join(ranges, ["session_id", "cell"]).where("start >= _from AND start < until")
    return placed.groupBy("session_id", "part_index").agg(F.min("first").alias("first_rec"), F.max("last").alias("last_rec"), F.sum("b").alias("part_bytes"))


def chunk_plan(transcripts: DataFrame, soft: int = 250_000, fold_turns: int = FOLD_TURNS) -> DataFrame:
    """(session_id, part_index, total_parts, first_rec, last_rec, part_bytes)."""
    turns = lines(transcripts).groupBy("session_id", "turn_no").agg(F.sum("n_bytes").alias("b"), F.min("rec_id").alias("first"), F.max("rec_id").alias("last"), F.max("end_byte").alias("_end"))
    turns = materialize(turns.withColumn("start", F.col("_end") - F.col("b")).drop("_end"), "turns")
    size = turns.groupBy("session_id").agg(F.sum("b").alias("total"), F.count("*").alias("n_turns"))
    size = size.withColumn("parts", F.ceil(F.col("total") / soft).cast("long"))
    size = size.withColumn("target", F.when(F.col("total") <= soft, F.col("total") + 1).otherwise(F.floor(F.col("total") / F.col("parts"))).cast("long"))
    turns = turns.join(size, "session_id")
    rows = _folded(turns.where(F.col("n_turns") <= fold_turns))
    if not size.where(F.col("n_turns") > fold_turns).isEmpty():
        rows = rows.unionByName(_doubled(turns.where(F.col("n_turns") > fold_turns)))
    n = rows.groupBy("session_id").agg(F.count("*").alias("total_parts"))
    return rows.join(n, "session_id").select("session_id", "part_index", "total_parts", "first_rec", "last_rec", "part_bytes")
