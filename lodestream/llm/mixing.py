"""Problem 9: a mixture of sources in target shares of all tokens, by cube-method balanced sampling.

For each source the number of times each of its documents is needed, on average, follows from its tokens, its share and the size of
the mixture. Its whole part is given to every document, the fraction is an inclusion probability. The cube method turns the probabilities into
decisions: in the flight phase they move through the null space of the balancing constraints (number of documents and number of
tokens stay as they are) until at most two per block are undecided; these go to the next level of blocks, and the last
few of a source land where the tokens are closest to their target.

Scale: blocks of ``BLOCK`` documents of a source are independent, so a source with a third of all rows is many tasks; each level keeps
at most two undecided documents of a block. Defined results: texts that are NULL or blank and sources without target are not used; sources are
compared without case, outer blanks and separators; a source without documents gets nothing and the size follows from the
others; repeated rows of a document count as documents of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import VOCABULARY, local_file, ship_file

BLOCK = 5_000
#: Units of middling size of each source that no flight touches, left to the landing: a very large text may stay undecided in the flight, and these make up for it.
SPARE = 15


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value of the vocabulary
    with open(local_file(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """A source in one spelling."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_"), F.lit(""))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the texts with content."""
    vocabulary = ship_file(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": np.array(n, np.int64)})

    some = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(r"text RLIKE '\\S'")
    return some.mapInPandas(run, "doc_id long, source string, tokens long")


def flight(prob: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase with two constraints, three undecided units at a time; at most two end undecided.

    With the scale of a step along the null space u of the constraints a (count and tokens over the probability), each move is up with the
    odds that keep every unit's expectation.
    """
    p, rng, n = prob.astype(float).copy(), np.random.default_rng(seed), len(prob)
    a = np.vstack([np.ones(n), tokens / max(1.0, float(tokens.mean()) if n else 1.0)])
    open_: list[int] = []
    for i in range(n):
        if not 1e-9 < p[i] < 1 - 1e-9:
            continue
        open_.append(i)
        while len(open_) == 3:
            x, y, z = open_
            u = np.array([a[1, y] - a[1, z], a[1, z] - a[1, x], a[1, x] - a[1, y]])  # orthogonal to the counts and to the tokens
            if not np.abs(u).max() > 1e-12:
                u = np.array([1.0, -1.0, 0.0])
            q = p[open_]
            up = min((1 - q[k]) / u[k] if u[k] > 0 else q[k] / -u[k] for k in range(3) if u[k])
            down = min(q[k] / u[k] if u[k] > 0 else (1 - q[k]) / -u[k] for k in range(3) if u[k])
            q = q + (up if rng.random() * (up + down) < down else -down) * u
            p[open_] = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
            open_ = [k for k in open_ if 0.0 < p[k] < 1.0]
    return p


def land(prob: np.ndarray, tokens: np.ndarray, short: float) -> np.ndarray:
    """Landing: of all ways to decide the few units left, the one whose tokens come closest to ``short``."""
    n = len(prob)
    choices = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
    off = np.abs(choices @ tokens - short) + 0.5 * np.abs(choices.sum(axis=1) - prob.sum())
    return choices[np.argmin(off)]


UNIT = "source string, doc_id long, tokens long, base int, prob double, block long, spare boolean"


def _level(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large texts first: the units that are left to land are then the smallest, and the token total is met best.
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        tokens, target = pdf.tokens.to_numpy(float), float((pdf.prob * pdf.tokens).sum())
        p = pdf.prob.to_numpy().copy()
        fly = np.flatnonzero(~pdf.spare.to_numpy(bool))
        p[fly] = flight(p[fly], tokens[fly], seed)
        undecided = np.flatnonzero((p > 0) & (p < 1))
        if last and len(undecided):
            p[undecided] = land(p[undecided], tokens[undecided], target - float(tokens[p >= 1].sum()))
        pdf["prob"] = p
        return pdf[[c.split()[0] for c in UNIT.split(", ")]]

    return run


def keep_back(units: DataFrame) -> DataFrame:
    """``spare``: SPARE units of each source of 4 * SPARE or more, from the large to the middling; each block proposes, one of its proposals is taken for each size."""
    w = Window.partitionBy("source", "block")
    n = F.count("*").over(w)
    place = (F.row_number().over(w.orderBy(F.col("tokens").desc(), "doc_id")) - 1).cast("int")
    low = F.greatest(F.lit(2.0), 0.004 * F.col("_n"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SPARE - 1)), lambda k: F.floor(low + k * (0.4 * F.col("_n") - low) / (SPARE - 1)).cast("int"))
    slot = F.when(F.col("n_docs") >= 4 * SPARE, F.nullif(F.array_position(slots, F.col("_place")), F.lit(0)))
    ranked = materialize(units.withColumns({"_n": n, "_place": place}).withColumn("slot", slot).drop("_n", "n_docs"), "cube-units")
    least = ranked.where("slot IS NOT NULL").groupBy("source", "slot").agg(F.min_by(F.struct("block", "_place"), F.xxhash64("doc_id", "block")).alias("s"))
    least = least.select("source", F.col("s.block").alias("block"), F.col("s._place").alias("_place"), F.lit(True).alias("spare"))
    return ranked.drop("slot").join(least, ["source", "block", "_place"], "left").drop("_place").withColumn("spare", F.coalesce("spare", F.lit(False)))


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used. ``total`` tokens; by default the most that the caps allow."""
    counts = materialize(token_counts(docs, vocabulary), "tokens")
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs")).join(want, "source")
    have = have.where("available > 0 AND target_share > 0")
    most = F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))
    size = have.agg(F.lit(float(total)) if total else most).first()[0]  # one number
    rate = have.select("source", "n_docs", F.least(F.col("max_repeats").cast("double"), F.lit(size or 0.0) * F.col("target_share") / F.col("available")).alias("rate"))
    units = counts.join(rate, "source").select("source", "doc_id", "tokens", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("prob"), "n_docs")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block))
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).cast("long"))
    units = keep_back(units)
    spare, units = units.where("spare").withColumn("block", F.lit(0).cast("long")), units.where("NOT spare")
    largest = have.agg(F.max("n_docs")).first()[0] or 0
    n_blocks, decided, level = -(-largest // block), None, 0
    while True:
        last = n_blocks <= 1
        units = units.unionByName(spare) if last else units
        done = materialize(units.groupBy("source", "block").applyInPandas(_level(seed + level, last), UNIT), f"cube-{level}")
        whole = done if last else done.where("prob = 0 OR prob = 1")
        decided = whole if decided is None else decided.unionByName(whole)
        if last:
            break
        n_blocks = -(-(2 * n_blocks) // block)
        units = done.where("prob > 0 AND prob < 1").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level + 1)), F.lit(n_blocks)).cast("long"))
        level += 1
    used = decided.select("doc_id", "source", "tokens", (F.col("base") + F.round("prob").cast("int")).alias("copies"))
    return used.where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the target, the tokens and documents used, the share reached and the most copies of a document."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mix_tokens").alias("all_tokens"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = want.join(got, "source", "left").join(F.broadcast(total))  # one row
    share = F.round(F.coalesce("mix_tokens", F.lit(0)) / F.col("all_tokens"), 6)
    return out.select("source", "target_share", "max_repeats", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), share.alias("actual_share"))
