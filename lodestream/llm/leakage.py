"""Problem 8: evaluation texts in training text, by winnowing.

Words are runs of letters and digits, without case. Of each text the hashes of all ``K`` consecutive words are taken and of each
window of ``WINDOW`` such hashes the least one (the rightmost of equals) is kept. Any shared run of ``K + WINDOW - 1`` = 12 words holds a
kept hash of both texts, so no such run is missed. A hit is extended to both sides, word by word, and reported if the
run reaches 12 words; that makes hash collisions harmless.

Scale: documents are read once, one narrow pass without a shuffle while the fingerprints of the evaluation items are
within ``BROADCAST_BYTES`` (checked on the written table); beyond that, document fingerprints are joined with item
fingerprints by hash, and only the documents hit are extended. Defined results: NULL, blank and short texts have
no run; repeated items each count; a repeated document row is reported per ``doc_id`` once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MIN_WORDS, K = 12, 6
WINDOW = MIN_WORDS - K + 1
#: Largest estimated size of the item side that is sent to every task.
BROADCAST_BYTES = 64 << 20
_WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class WordHash:
    """64-bit hashes of words, each computed once per task."""

    def __init__(self) -> None:
        import xxhash

        self.known: dict[str, int] = {}
        self.digest = xxhash.xxh3_64_intdigest

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(known) > 2_000_000:
                known.clear()
            known.update({w: self.digest(w) for w in set(ws) - known.keys()})
            return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` words from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * _MUL + h[i : i + n]
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept by winnowing: in each window the rightmost least hash. A text with fewer hashes keeps its least one."""
    n = len(g)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.arange(len(view)) + (w - 1 - view[:, ::-1].argmin(axis=1))
    return np.unique(at)


def extend(a: list[str], i: int, b: list[str], j: int, k: int) -> tuple[int, int]:
    """The longest run that a[i:i+k] and b[j:j+k] belong to: start in a, length; (i, 0) if the words there differ."""
    if a[i : i + k] != b[j : j + k]:
        return i, 0
    lo, hi = 0, k
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return i - lo, lo + hi


def fingerprints(df: DataFrame, key: str) -> DataFrame:
    """(key, fp, pos) of the ``text`` column; nothing else is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_hash = WordHash()
        for pdf in batches:
            keys, fps, poss = [], [], []
            for k, text in zip(pdf[key], pdf["text"]):
                g = gram_hashes(word_hash(words(text)))
                at = winnow(g)
                keys.append(np.full(len(at), k, np.int64))
                fps.append(g[at].view(np.int64))
                poss.append(at)
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pd.DataFrame({key: cat(keys), "fp": cat(fps), "pos": cat(poss).astype(np.int32)})

    return df.select(key, "text").where("text IS NOT NULL").mapInPandas(run, f"{key} long, fp long, pos int")


HIT = "doc_id long, item_id long, word_pos int, n_words int"


def _extend_all(docs: DataFrame, items: dict[int, list[str]], index: dict[int, list[tuple[int, int]]]) -> DataFrame:
    bc = docs.sparkSession.sparkContext.broadcast((items, index))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, index = bc.value
        wanted = np.sort(np.fromiter(index.keys(), np.uint64, len(index)))
        word_hash = WordHash()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ws = words(text)
                g = gram_hashes(word_hash(ws))
                at = winnow(g)
                if not len(at) or not len(wanted):
                    continue
                fp = g[at]
                near = np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)
                best: dict[int, tuple[int, int]] = {}
                for p, f in zip(at[wanted[near] == fp].tolist(), fp[wanted[near] == fp].tolist()):
                    for item, j in index[f]:
                        start, n = extend(ws, p, items[item], j, K)
                        if n >= MIN_WORDS and n > best.get(item, (0, 0))[1]:
                            best[item] = (start, n)
                rows += [(doc, item, s, n) for item, (s, n) in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "word_pos", "n_words"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, HIT)


def leaks(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each (document, item) that shares 12 consecutive words, with place and length of the longest run found."""
    item_fp = materialize(fingerprints(items, "item_id"), "item-fp")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * 8 + item_fp.count() * 64
    if size <= broadcast_bytes:
        texts = {r.item_id: words(r.text) for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator()}
        index: dict[int, list[tuple[int, int]]] = {}
        for r in item_fp.toLocalIterator():
            index.setdefault(r.fp & (2**64 - 1), []).append((r.item_id, r.pos))
        return _extend_all(docs, texts, index).groupBy("doc_id", "item_id").agg(F.max_by("word_pos", "n_words").alias("word_pos"), F.max("n_words").alias("n_words"))
    return _joined(docs, items, item_fp)


def _joined(docs: DataFrame, items: DataFrame, item_fp: DataFrame) -> DataFrame:
    """The way beyond the bound: fingerprints joined by hash, then both texts brought to each candidate pair."""
    i = item_fp.withColumnRenamed("pos", "item_pos")
    pairs = fingerprints(docs, "doc_id").join(i, "fp").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("pos", "item_pos")).alias("hits"))
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, hits, a, b in zip(pdf.doc_id, pdf.item_id, pdf.hits, pdf.text, pdf.item_text):
                wa, wb = words(a), words(b)
                s, n = max((extend(wa, h["pos"], wb, h["item_pos"], K) for h in hits), key=lambda x: x[1])
                if n >= MIN_WORDS:
                    rows.append((doc, item, s, n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "word_pos", "n_words"])

    return both.select("doc_id", "item_id", "hits", "text", "item_text").mapInPandas(run, HIT)


def leaked_items(hits: DataFrame) -> DataFrame:
    """Which items leaked, into how many documents, and their longest run."""
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_run"))
