"""Problem 10: long exact spans shared between records, by FM-indexes.

1. Seeds: of each document the hashes of all ``SEED`` consecutive characters are winnowed so that every stretch of ``MIN_LEN`` characters holds
   a kept seed. Only seeds of two or more documents matter, and of a chain of seeds that always occur together only the first, so the
   texts to index are the surroundings (windows) of few seeds; no shared stretch of ``MIN_LEN`` is missed.
2. Windows are put into shards by what any long enough stretch around the seed must contain besides it (75 more characters to the left or to the
   right), so partners always meet in a shard, and a shard's size does not grow with the corpus.
3. Each shard builds one FM-index (suffix order, Burrows-Wheeler transform, wavelet matrix) over its windows and streams the windows through
   it, all in step: backward search gives how far each seed extends to the left beside another window (matching statistics), then each
   such end is searched with ``MIN_LEN`` characters; the suffix range that is left names the partners.
4. ``shares`` joins the texts of found pairs and extends each hit to its full length.

Groups: exact copies of a text are one class, represented by its least ``doc_id``; a shard key that holds more than ``BLOCK`` windows is
indexed in blocks, each searched by blocks of the key's windows. Classes of at most ``EXPAND`` copies are expanded into all pairs; of larger
ones each copy is paired with the representative, which carries the links to other texts. If more than ``4 * EXPAND`` places of a shard hold
one same stretch, the shard gives its members instead of their pairs; all pairs of different texts are then spelt out from these by a join in
blocks of ``MEMBERS`` documents, so that no task holds more than a block's pairs.

Defined results: NULL texts and texts under ``MIN_LEN`` characters share nothing; positions and lengths are in characters (code points).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

MIN_LEN, SEED = 300, 150
SPAN = MIN_LEN - SEED + 1  # seeds in a stretch of MIN_LEN
SIDE = MIN_LEN - SEED  # characters that matter on either side of a seed
WINDOW = SIDE + MIN_LEN
HALF = SIDE // 2
BLOCK, SHARD_WINDOWS, EXPAND, MEMBERS = 4_000, 2_000, 16, 500
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POS_BITS = np.uint64(26)


def seed_hashes(codes: np.ndarray, k: int = SEED) -> np.ndarray:
    """Hash of each run of ``k`` characters by doubling: runs of 1, 2, 4 ... and two overlapping runs for the rest."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, w, mul = codes.astype(np.uint64) * _A + _B, 1, int(_A)
    h ^= h >> np.uint64(31)
    while w * 2 <= k:
        h = h[:-w] * np.uint64(mul) + h[w:]
        h ^= h >> np.uint64(29)
        mul, w = (mul * int(_B) | 1) & (2**64 - 1), w * 2
    if w < k:
        h = h[:n] * np.uint64(mul) + h[k - w : k - w + n]
        h *= _A
        h ^= h >> np.uint64(32)
    return h[:n]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of ``w`` by doubling."""
    m, k = v, 1
    while k * 2 <= w:
        m, k = np.minimum(m[:-k], m[k:]), k * 2
    n = len(v) - w + 1
    return np.minimum(m[:n], m[w - k : w - k + n])


def seeds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Kept seeds of a text: positions and hashes. In each window of SPAN seeds the rightmost least one is kept."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = seed_hashes(codes)
    if len(h) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out, step = [], 1 << 25
    for s in range(0, len(h) - SPAN + 1, step):  # positions must fit beside the hash
        part = h[s : s + step + SPAN - 1]
        inv = np.uint64((1 << 26) - 1) - np.arange(len(part), dtype=np.uint64)
        m = sliding_min((part >> _POS_BITS << _POS_BITS) | inv, SPAN)
        m = m[np.append(True, m[1:] != m[:-1])]
        out.append(s + ((1 << 26) - 1) - (m & np.uint64((1 << 26) - 1)).astype(np.int64))
    at = np.unique(np.concatenate(out))
    return at, h[at]


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, fp, before) of all kept seeds; ``before`` is a hash of the seed before it and the distance, 0 if that is over SEED. Texts are read once and not shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs_, places, fps, before = [], [], [], []
            for doc, text in zip(pdf.doc_id, pdf.text):
                at, fp = seeds_of(text)
                if len(at):
                    gap = np.diff(at).astype(np.uint64)
                    link = np.where(gap <= np.uint64(SEED), ((fp[:-1] + gap * _B) * _A) | np.uint64(1), np.uint64(0))
                    docs_.append(np.full(len(at), doc))
                    places.append(at.astype(np.int32))
                    fps.append(fp.view(np.int64))
                    before.append(np.append(np.uint64(0), link).view(np.int64))
            cols = zip(("doc_id", "pos", "fp", "before"), (docs_, places, fps, before), (np.int64, np.int32, np.int64, np.int64))
            yield pd.DataFrame({n: np.concatenate(c) if c else np.empty(0, t) for n, c, t in cols})

    long_enough = docs.select("doc_id", "text").where(F.char_length("text") >= MIN_LEN)
    return long_enough.mapInPandas(run, "doc_id long, pos int, fp long, before long")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, n_copies) of texts of MIN_LEN or more: exact copies by digest, the least id represents."""
    d = docs.where(F.char_length("text") >= MIN_LEN).select("doc_id", F.sha2("text", 256).alias("digest"))
    g = d.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    return d.join(g.where("n_copies > 1"), "digest").select("doc_id", "rep", "n_copies")


def heads(seed_rows: DataFrame, copied: DataFrame) -> DataFrame:
    """Seeds of several texts that start a chain, at each place: (doc_id, places)."""
    own = seed_rows.join(copied.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti").repartition("fp")  # one shuffle serves the counts and the join
    g = own.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("before").alias("p"), F.max("before").alias("q"))
    kept = g.where((F.col("a") < F.col("b")) & ((F.col("p") != F.col("q")) | (F.col("p") == 0))).select("fp")
    return own.join(kept, "fp", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("places"))


def windows(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(key, doc_id, start, win): around each place MIN_LEN - SEED characters to the left, MIN_LEN from it on; padded with NUL at the text's ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for doc, text, places in zip(pdf.doc_id, pdf.text, pdf.places):
                text = text.replace("\0", "�")
                seen: set[str] = set()
                for p in sorted(places):
                    lo, hi = p - SIDE, p + MIN_LEN
                    win = "\0" * max(0, -lo) + text[max(0, lo) : hi] + "\0" * max(0, hi - len(text))
                    if win in seen:  # a text that repeats itself: its equal windows find the same partners
                        continue
                    seen.add(win)
                    for side, part in (("l", win[SIDE - HALF : SIDE + SEED]), ("r", win[SIDE : SIDE + SEED + HALF])):
                        if "\0" not in part:
                            rows.append((xxhash.xxh3_64_intdigest(side + part) - (1 << 63), doc, lo, win))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "start", "win"])

    return docs.select("doc_id", "text").join(at, "doc_id").select("doc_id", "text", "places").mapInPandas(run, "key long, doc_id long, start long, win string")


class WaveletMatrix:
    """Rank of any symbol before any position, in one step per bit of the alphabet, for many queries at once."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ranks = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ranks[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            r_lo, r_i = ones[lo], ones[i]
            lo, i = np.where(one, zeros + r_lo, lo - r_lo), np.where(one, zeros + r_i, i - r_i)
        return i - lo


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling, exact for the first ``depth`` characters."""
    rank = t.astype(np.int64)
    k, n = 1, len(t)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2 + int(rank.max())) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        rank, k = new, k * 2
        if k >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Index of fixed-width rows of codes (0 pads and ends a row): backward search for many patterns in step."""

    def __init__(self, rows: np.ndarray, sigma: int) -> None:
        self.width = rows.shape[1] + 1
        t = np.concatenate([rows, np.zeros((len(rows), 1), rows.dtype)], axis=1).ravel()
        self.sa = suffix_order(t, self.width)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.bwt = WaveletMatrix(t[self.sa - 1], max(1, int(sigma - 1).bit_length()))

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend each range by the character before it; the padding matches nothing."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c]
        n = len(c)
        return base + both[:n], np.where(c == 0, base + both[:n], base + both[n:])


Hit = tuple[int, int, int, int]
Members = tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int]]]


def search(index_rows: np.ndarray, index_id: np.ndarray, rows: np.ndarray, ids: np.ndarray, inside: np.ndarray, sigma: int) -> tuple[list[Hit], list[Members]]:
    """Shared MIN_LEN stretches around the seed. ``inside``: the row itself is indexed.

    First (query row, index row, offset in the query row, offset in the index row); then of the stretches at many places a query row and its
    offset that spell it, the index rows that hold it, their offsets, and all such query rows with offsets.
    """
    fm = FMIndex(index_rows, sigma)
    need = 1 + inside.astype(np.int64)
    q = np.arange(len(rows))
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(fm.sa), np.int64)
    tasks: list[tuple[np.ndarray, int]] = []
    size = None
    for off in range(SIDE + SEED - 1, -1, -1):
        nlo, nhi = fm.step(rows[q, off], lo, hi)
        alive = nhi - nlo >= need[q]
        if off < SIDE:  # left of the seed: where a range shrinks, some partner's extension ends
            left = SIDE - off - 1
            ended = (nhi - nlo < size) & (left > 0)
            if ended.any():
                tasks.append((q[ended], left))
        q, lo, hi = q[alive], nlo[alive], nhi[alive]
        size = hi - lo
        if not len(q):
            break
    if len(q):
        tasks.append((q, SIDE))
    tasks.append((np.arange(len(rows)), 0))
    tq = np.concatenate([t for t, _ in tasks])
    tl = np.concatenate([np.full(len(t), left) for t, left in tasks])
    start = SIDE - tl
    lo, hi, k = np.zeros(len(tq), np.int64), np.full(len(tq), len(fm.sa), np.int64), np.arange(len(tq))
    for d in range(MIN_LEN - 1, -1, -1):
        lo, hi = fm.step(rows[tq[k], start[k] + d], lo, hi)
        alive = hi - lo >= need[tq[k]]
        k, lo, hi = k[alive], lo[alive], hi[alive]
        if not len(k):
            return [], []
    out: list[Hit] = []
    many: dict[tuple[int, int], list[tuple[int, int]]] = {}
    row_of, doc_of = fm.sa // fm.width, index_id[np.minimum(fm.sa // fm.width, len(index_id) - 1)]
    seen: set[tuple[int, int, int]] = set()
    for i, a, b in zip(k.tolist(), lo.tolist(), hi.tolist()):
        me = int(tq[i])
        if (me, a, b) in seen:
            continue
        seen.add((me, a, b))
        if b - a > 4 * EXPAND:  # many occurrences: their pairs are made later, in blocks
            many.setdefault((a, b), []).append((me, int(start[i])))
            continue
        docs = doc_of[a:b]
        at = [int(j) for j in np.unique(docs, return_index=True)[1] if docs[j] != ids[me]]
        out += [(me, int(row_of[a + j]), int(start[i]), int(fm.sa[a + j] % fm.width)) for j in at]
    return out, [(*mine[0], row_of[a:b], fm.sa[a:b] % fm.width, mine) for (a, b), mine in many.items()]


#: A pair with a place in each; or, with a ``stretch`` and no ``doc_b``, a document that holds this stretch.
HITS = "doc_a long, doc_b long, pos_a long, pos_b long, stretch string"


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Index the shard's own windows, stream those that ask."""
    import xxhash

    columns = [c.split()[0] for c in HITS.split(", ")]
    if not len(pdf):
        return pd.DataFrame([], columns=columns)
    chars = np.frombuffer("".join(pdf.win).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pdf), WINDOW)
    alphabet, codes = np.unique(np.append(0, chars), return_inverse=True)
    rows = codes[1:].reshape(len(pdf), WINDOW).astype(np.int64)
    ids, start, own, asks = pdf.doc_id.to_numpy(), pdf.start.to_numpy(), pdf.own.to_numpy(), np.flatnonzero(pdf.asks)
    at = np.flatnonzero(own)
    found, many = search(rows[at], ids[at], rows[asks], ids[asks], own[asks], len(alphabet)) if len(at) and len(asks) else ([], [])
    out, members = [], []
    for me, other, mine, theirs in found:
        a, b, pa, pb = int(ids[asks][me]), int(ids[at][other]), int(start[asks][me]) + mine, int(start[at][other]) + theirs
        out.append((a, b, pa, pb, None) if a < b else (b, a, pb, pa, None))
    for me, mine, index_rows, offsets, asked in many:
        stretch = xxhash.xxh3_128_hexdigest(chars[asks[me], mine : mine + MIN_LEN].tobytes())
        q, off = np.array(asked).T
        places = np.stack([np.append(ids[at[index_rows]], ids[asks[q]]), np.append(start[at[index_rows]] + offsets, start[asks[q]] + off)], axis=1)
        places = np.unique(places, axis=0)
        if places[0, 0] != places[-1, 0]:
            members.append(pd.DataFrame({"doc_a": places[:, 0], "doc_b": pd.array([None] * len(places), "Int64"), "pos_a": places[:, 1], "pos_b": pd.array([None] * len(places), "Int64"), "stretch": stretch}))
    pairs_found = pd.DataFrame(list(dict.fromkeys(out)), columns=columns).astype({"doc_b": "Int64", "pos_b": "Int64"})
    return pd.concat([pairs_found, *members], ignore_index=True) if members else pairs_found


def spelt_out(members: DataFrame, places: bool) -> DataFrame:
    """(doc_a, doc_b, pos_a, pos_b) of all pairs of documents that hold a same stretch, by blocks of ``MEMBERS`` documents of it.

    ``places``: every place of a document meets the first place in each other one; else each pair of documents once for each set of
    documents that holds some stretch.
    """
    first = members.groupBy("stretch", "doc_id").agg(F.min("pos").alias("pos"))
    sets = first.groupBy("stretch").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    blocks = sets if places else sets.groupBy("n", "x", "y").agg(F.min("stretch").alias("stretch"))
    blocks = blocks.select("stretch", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
    own, last = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.col("blocks") - 1
    left = (members if places else first).join(blocks, "stretch").withColumn("i", own)
    left = left.select("stretch", "i", F.explode(F.sequence(F.lit(0) if places else F.col("i"), last)).alias("j"), F.col("doc_id").alias("a"), F.col("pos").alias("pa"))
    right = first.join(blocks, "stretch").withColumn("j", own)
    right = right.select("stretch", F.explode(F.sequence(F.lit(0), last if places else F.col("j"))).alias("i"), "j", F.col("doc_id").alias("b"), F.col("pos").alias("pb"))
    both = left.join(right.hint("merge"), ["stretch", "i", "j"]).where("a <> b" if places else "a <> b AND (i < j OR a < b)")
    up = F.col("a") < F.col("b")
    return both.select(
        F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), F.when(up, F.col("pa")).otherwise(F.col("pb")).alias("pos_a"), F.when(up, F.col("pb")).otherwise(F.col("pa")).alias("pos_b")
    )


@contextmanager
def bloom_filtered(spark: SparkSession) -> Iterator[None]:
    """Let Spark filter the larger side of a join by a Bloom filter of the smaller one's keys (8 MB at most) at any size; the settings are put back."""
    wanted = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1GB"}
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def hits(docs: DataFrame, copied: DataFrame, places: bool = False) -> DataFrame:
    """A place of MIN_LEN shared characters for each pair of representatives that shares any; ``places`` as in ``spelt_out``."""
    at = materialize(heads(materialize(seeds(docs), "seeds"), copied), "places").where(F.size("places") > 0)
    with bloom_filtered(docs.sparkSession):  # of the texts only those with a place are shuffled
        win = materialize(windows(docs, at), "windows")
    n = win.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key", "n")
    shared = win.join(n, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shards = max(1, win.count() // SHARD_WINDOWS)
    # a hot key: each block of it is the index of one shard for each block that asks
    shared = shared.withColumn("_own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    shared = shared.withColumn("_all", F.sequence(F.lit(0), blocks - 1))
    as_index = F.transform("_all", lambda x: F.struct(F.col("_own").alias("i"), x.alias("j")))
    as_query = F.transform("_all", lambda x: F.struct(x.alias("i"), F.col("_own").alias("j")))
    shared = shared.withColumn("_at", F.explode(F.array_union(as_index, as_query)))
    hot = F.col("n") > BLOCK
    shard = F.when(hot, F.concat_ws(":", "key", "_at.i", "_at.j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string"))
    rows = shared.select(shard.alias("shard"), "doc_id", "start", "win", (F.col("_at.i") == F.col("_own")).alias("own"), (F.col("_at.j") == F.col("_own")).alias("asks")).distinct()
    found = materialize(rows.groupBy("shard").applyInPandas(_shard, HITS), "hits")
    members = found.where("stretch IS NOT NULL").select("stretch", F.col("doc_a").alias("doc_id"), F.col("pos_a").alias("pos")).distinct()
    return found.where("stretch IS NULL").drop("stretch").unionByName(spelt_out(members, places)).distinct()


def pairs(docs: DataFrame) -> DataFrame:
    """p10_found: (doc_a, doc_b), doc_a < doc_b; see the module's text for groups of copies."""
    copied = materialize(copies(docs), "copies")
    found = hits(docs, copied).select("doc_a", "doc_b").distinct()
    star = copied.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    few = copied.where(F.col("n_copies") <= EXPAND)
    within = few.alias("x").join(few.alias("y"), F.expr("x.rep = y.rep AND x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"))
    more = few.where("doc_id <> rep")
    member = lambda c: more.select(F.col("rep").alias(c), F.col("doc_id").alias(f"_{c}"))
    spread = found.join(member("doc_a"), "doc_a", "left").join(member("doc_b"), "doc_b", "left")
    a, b = F.array("doc_a", "_doc_a"), F.array("doc_b", "_doc_b")
    spread = spread.select(F.explode(F.array_compact(a)).alias("a"), F.array_compact(b).alias("bs")).select("a", F.explode("bs").alias("b"))
    spread = spread.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    return found.unionByName(star).unionByName(within).unionByName(spread).distinct()


def members(docs: DataFrame) -> DataFrame:
    """Membership of the classes of exact copies that ``pairs`` writes as (representative, copy): (doc_id, rep, n_copies) of all texts with copies."""
    return copies(docs)


def shares(docs: DataFrame) -> DataFrame:
    """Per document the number and characters of its shared stretches, and the share of its text that they make up.

    Each hit is extended, letter by letter, to its full length in both texts; stretches of a document are united before they are
    counted. A text with exact copies is shared as a whole.
    """
    copied = materialize(copies(docs), "copies")
    found = hits(docs, copied, places=True)
    text = docs.select("doc_id", "text")
    both = found.join(text.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("ta")), "doc_a").join(text.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("tb")), "doc_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, pa, pb, ta, tb in zip(pdf.doc_a, pdf.doc_b, pdf.pos_a, pdf.pos_b, pdf.ta, pdf.tb):
                x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (ta, tb))
                n = min(len(x) - pa, len(y) - pb)
                differ = np.flatnonzero(x[pa : pa + n] != y[pb : pb + n])
                right = int(differ[0]) if len(differ) else n
                m = min(pa, pb)
                differ = np.flatnonzero(x[pa - m : pa][::-1] != y[pb - m : pb][::-1])
                left = int(differ[0]) if len(differ) else m
                rows += [(a, pa - left, pa + right), (b, pb - left, pb + right)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e"])

    spans = both.select("doc_a", "doc_b", "pos_a", "pos_b", "ta", "tb").mapInPandas(run, "doc_id long, s long, e long").distinct()
    whole = copied.select("doc_id").join(text, "doc_id").select("doc_id", F.lit(0).cast("long").alias("s"), F.char_length("text").cast("long").alias("e"))
    spans = spans.unionByName(whole)
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_seen", F.coalesce(seen, F.lit(-1))).withColumn("fresh", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "_seen")))
    total = new.groupBy("doc_id").agg(F.sum((F.col("s") > F.col("_seen")).cast("long")).alias("n_stretches"), F.sum("fresh").alias("shared_chars"))
    return total.join(docs.select("doc_id", F.char_length("text").alias("n")), "doc_id").select("doc_id", "n_stretches", "shared_chars", F.round(F.col("shared_chars") / F.col("n"), 4).alias("shared_part"))
