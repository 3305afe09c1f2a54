"""Problem 2: new batches against all accepted history, by a segment index for edit distance.

A summary is read as its sequence of content words. Each accepted sequence of length L is stored as ``tau_of(L) + 1`` even segments, under
a key of the numbers it names, its length, the segment's number and its text. If two sequences are within ``tau_of`` of the shorter one,
a segment of the stored one occurs unchanged in the other near its place, so a new one probes only the substrings that the
multi-match-aware selection allows, for the lengths that the index holds for its numbers. Candidates are verified: bounded edit distance, the same
numbers, and every word that one of them quotes (values, files, commands, components) is in the other.

How much may differ grows with the length: nothing under ``SHORTEST`` content words, one misspelt word (``respelt``) under ``SHORT``, beyond that a third
of the words, ``TAU`` at most. Short texts say too little for a changed word to be the same statement.

``SegmentIndex.take`` takes all rows that wait, of one batch or of several, and decides them in order of ``entry_no`` as if they came one by
one. The tables of the index are partitioned by hash buckets of their keys; a take reads only the buckets that its rows probe, and appends
what it accepts. History is never segmented, compared or rewritten again. The number of jobs does not depend on the number of batches: rows are
decided in rounds over the verified pairs (rows without earlier undecided partner are kept, rows that repeat them are not).

Scale: exact copies are one class with one representative, so a class with a third of all rows gives no pairs but (kept, member). A key that
more than ``HOT`` stored classes share is narrowed by a quoted word of the stored text, which any partner must contain; what is hot even then is split into
blocks, so that no task holds a whole key, and pairs are verified where they are joined.

Defined results: an ``id`` counts without case and outer blanks, NULL and blank ids match nothing; a NULL or blank summary, or
one of stop words only, matches nothing; a row that repeats several kept rows gives a pair with each of them; rows without ``entry_no`` have no place
in the order and are left out; rows without ``batch_no`` count as waiting.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

TAU, SHORT, SHORTEST = 6, 8, 4
#: Buckets of each table of the index; stored classes of a key before it is narrowed and split.
BUCKETS, HOT = 16, 200
#: Function words that rewording adds or drops; they are not part of the compared sequence (fixed values).
STOP = (
    "a an the of in on at to for by with and or as is are was be been it its this that so then also too well again once from into not no do "
    "does will would must may can short note already per via than out our we you"
).split()
QUOTED = r"`+([^`]+)`+|\B'([^']+)'\B|\"([^\"]+)\""


def tau_of(n: int) -> int:
    """Word edits that a text of ``n`` content words may differ by."""
    return 0 if n < SHORTEST else 1 if n < SHORT else min(TAU, n // 3)


def _tau(n: Column) -> Column:
    return F.when(n < SHORTEST, 0).when(n < SHORT, 1).otherwise(F.least(F.lit(TAU), F.floor(n / 3).cast("int")))


def features(entries: DataFrame) -> DataFrame:
    """(entry_no, id_key, words, all_words, sig, must, class): what the index compares; other columns are dropped."""
    low = F.lower(F.coalesce("summary", F.lit("")))
    all_words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)
    quoted = F.array_join(F.regexp_extract_all(low, F.lit(QUOTED), 0), " ")
    df = entries.where("entry_no IS NOT NULL").select(
        F.col("entry_no").cast("long").alias("entry_no"), F.nullif(F.lower(F.trim("id")), F.lit("")).alias("id_key"),
        F.filter(all_words, lambda w: ~w.isin(*STOP)).alias("words"), all_words.alias("all_words"),
        F.array_join(F.array_sort(F.regexp_extract_all(low, F.lit(r"\d+"), 0)), " ").alias("sig"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(quoted, F.lit(r"[\p{L}\p{N}]+"), 0))).alias("must"),
    )
    text = F.concat_ws("\x1f", F.array_join("all_words", " "), F.array_join("must", " "))
    return df.withColumn("class", F.when(F.size("words") > 0, F.xxhash64(text)))


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct summary (words and quoted words) of the rows."""
    return rows.where("class IS NOT NULL").groupBy("class").agg(*[F.any_value(c).alias(c) for c in ("words", "all_words", "sig", "must")])


def _cut(df: DataFrame) -> DataFrame:
    """Add number, place and width of each even segment of a text of ``len`` words."""
    m, n = _tau(F.col("len")) + 1, F.col("len")
    each = df.withColumns({"m": m}).withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    base, long_from, i = F.floor(n / F.col("m")).cast("int"), F.col("m") - n % F.col("m"), F.col("seg_no")
    return each.withColumns({"pos": (i * base + F.greatest(F.lit(0), i - long_from)).cast("int"), "width": (base + (i >= long_from).cast("int")).cast("int")})


def _key(at: Column) -> Column:
    return F.xxhash64("sig", "len", "seg_no", F.array_join(F.slice("words", at + 1, F.col("width")), " "))


def segments(cls: DataFrame) -> DataFrame:
    """(key, class, hint) of the segments of each class; no segment is empty. ``hint`` is a quoted word that any partner contains, or ''."""
    hint = F.coalesce(F.get(F.sort_array(F.transform("must", lambda w: F.struct(-F.length(w), w.alias("w")))), F.lit(0))["w"], F.lit(""))
    return _cut(cls.withColumn("len", F.size("words"))).select(_key(F.col("pos")).alias("key"), "class", hint.alias("hint"))


def probes(cls: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, new_class) of the selected substrings of each new class, for every stored (sig, len) within reach."""
    n, tau = F.col("n"), F.col("m") - 1
    near = cls.select("class", "sig", "words", F.size("words").alias("n")).join(lengths, "sig")
    each = _cut(near.where(F.abs(n - F.col("len")) <= _tau(F.least("n", "len"))))
    i, delta = F.col("seg_no"), n - F.col("len")
    lo = F.greatest(F.lit(0), F.col("pos") - i, F.col("pos") + delta - (tau - i))
    hi = F.least(n - F.col("width"), F.col("pos") + i, F.col("pos") + delta + (tau - i))
    at = each.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).where("_lo <= _hi").withColumn("q", F.explode(F.sequence("_lo", "_hi")))
    return at.select(_key(F.col("q")).alias("key"), F.col("class").alias("new_class"))


def within(a: list[str], b: list[str], tau: int) -> bool:
    """Edit distance of two sequences is at most ``tau``: a band of width 2 tau + 1 with early end."""
    if abs(len(a) - len(b)) > tau:
        return False
    far = tau + 1
    prev = {j: j for j in range(min(len(b), tau) + 1)}
    for i, x in enumerate(a, 1):
        cur = {}
        for j in range(max(0, i - tau), min(len(b), i + tau) + 1):
            best = prev.get(j, far) + 1
            if j:
                best = min(best, cur.get(j - 1, far) + 1, prev.get(j - 1, far) + (x != b[j - 1]))
            cur[j] = best
        prev = cur
        if min(prev.values()) > tau:
            return False
    return prev.get(len(b), far) <= tau


def respelt(a: str, b: str) -> bool:
    """One word in two spellings: five letters or more, no digits, and one letter changed, added, dropped or swapped with its neighbour."""
    if min(len(a), len(b)) < 5 or not (a.isalpha() and b.isalpha()):
        return False
    if len(a) == len(b):
        off = [k for k in range(len(a)) if a[k] != b[k]]
        return len(off) == 1 or len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]
    return within(list(a), list(b), 1)


def same(a: list[str], b: list[str]) -> bool:
    """Do two sequences of content words say the same, by the rule of the module's text?"""
    n = min(len(a), len(b))
    if n >= SHORT:
        return within(a, b, tau_of(n))
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return len(a) == len(b) and len(off) <= tau_of(n) and all(respelt(x, y) for x, y in off)


def spread(stored: DataFrame, asked: DataFrame, all_words: DataFrame, hot: int = HOT) -> DataFrame:
    """Candidates (class, new_class) of stored (key, class, hint) and asked (key, new_class); hot keys are narrowed, then split."""
    n = stored.groupBy("key").agg(F.when(F.count("*") > hot, True).alias("_hot"))
    s, q = stored.join(n, "key"), asked.join(n, "key")  # most probes end here
    s = s.select("key", "class", F.when(F.col("_hot"), F.col("hint")).otherwise("").alias("word"))
    words = all_words.select(F.col("class").alias("new_class"), F.array_append(F.array_distinct("all_words"), F.lit("")).alias("_words"))
    cool = q.where("_hot IS NULL").select("key", "new_class", F.lit("").alias("word"))
    q = cool.unionByName(q.where("_hot").join(words, "new_class").select("key", "new_class", F.explode("_words").alias("word")))
    n = s.groupBy("key", "word").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks")).where("blocks > 1")
    s, q = s.join(n, ["key", "word"], "left"), q.join(n, ["key", "word"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    s = s.select("key", "word", "class", own("class").alias("i"), every.alias("j"))
    q = q.select("key", "word", "new_class", own("new_class").alias("j"), every.alias("i"))
    return s.join(q, ["key", "word", "i", "j"]).select("class", "new_class")


def verify(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidate pairs (class, new_class) that hold: quoted words are shared both ways, then bounded edit distance."""
    o = old.select("class", F.col("words").alias("w1"), F.col("all_words").alias("a1"), F.col("must").alias("m1"))
    n = new.select(F.col("class").alias("new_class"), F.col("words").alias("w2"), F.col("all_words").alias("a2"), F.col("must").alias("m2"))
    both = pairs.join(o, "class").join(n, "new_class")
    both = both.where((F.size(F.array_except("m1", "a2")) == 0) & (F.size(F.array_except("m2", "a1")) == 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [same(list(a), list(b)) for a, b in zip(pdf.w1, pdf.w2)]
            yield pdf.loc[ok, ["class", "new_class"]]

    return both.select("class", "new_class", "w1", "w2").mapInPandas(run, "class long, new_class long")


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


#: Tables of the index and the columns whose hash gives a row's bucket.
TABLES = {
    "segments": ("key long, class long, hint string", ("key",)),
    "lengths": ("sig string, len int", ("sig",)),
    "classes": ("class long, kept_no long, words array<string>, all_words array<string>, must array<string>", ("class",)),
    "ids": ("id_key string, kept_no long", ("id_key",)),
}


class SegmentIndex:
    """The accepted entries as tables that only grow: segments, the lengths stored per numbers, classes and ids. A root can be opened again."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or shared_path(spark, "segment-index")
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/index/segments")
        self.filled = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table of this take and read it back, without a job that infers its schema."""
        path = shared_path(self.spark, f"{self.root.rstrip('/').rsplit('/', 1)[-1]}-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def probe(self, name: str, asked: DataFrame) -> DataFrame:
        """Rows of a table of the index in the buckets of the asked keys; other buckets are not read (at most ``BUCKETS`` numbers reach the driver)."""
        schema, key = TABLES[name]
        if not self.filled:
            return self.spark.createDataFrame([], schema)
        wanted = sorted(r[0] for r in asked.select(_bucket(*key).alias("b")).distinct().collect())
        table = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/index/{name}")
        return table.where(F.col("bucket").isin(wanted)).drop("bucket")

    def append(self, kept: DataFrame) -> None:
        """Add accepted rows. Nothing stored before is read or rewritten."""
        cls = classes(kept).join(kept.where("class IS NOT NULL").groupBy("class").agg(F.min("entry_no").alias("kept_no")), "class")
        new = {
            "segments": segments(cls), "lengths": cls.select("sig", F.size("words").alias("len")).distinct(), "classes": cls.select("class", "kept_no", "words", "all_words", "must"),
            "ids": kept.where("id_key IS NOT NULL").select("id_key", F.col("entry_no").alias("kept_no")),
        }

        def write(name: str) -> None:
            new[name].withColumn("bucket", _bucket(*TABLES[name][1])).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/index/{name}")

        with ThreadPoolExecutor(len(new)) as pool:  # four small jobs at once
            list(pool.map(write, new))
        self.filled = True

    def take(self, entries: DataFrame) -> DataFrame:
        """Decide all rows of ``entries``: (kept_no, entry_no) of those that repeat a kept row; the others go into the index."""
        rows = self._save(features(entries), "rows")
        cls = self._save(classes(rows), "classes")
        own = self._save(segments(cls), "segments")
        lengths = self.probe("lengths", cls).unionByName(cls.select("sig", F.size("words").alias("len"))).distinct()
        asked = self._save(probes(cls, lengths), "probes")
        found = spread(own, asked, cls).where("class < new_class").withColumn("is_new", F.lit(True))
        if self.filled:
            touched = self._save(self.probe("segments", asked).join(asked.select("key").distinct(), "key", "left_semi"), "touched")
            found = found.unionByName(spread(touched, asked, cls).withColumn("is_new", F.lit(False)))
        found = self._save(found.distinct(), "candidates")
        one_way = verify(found.where("is_new").drop("is_new"), cls, cls)
        both = self._save(one_way.unionByName(one_way.select(F.col("new_class").alias("class"), F.col("class").alias("new_class"))), "near")
        both = both.unionByName(cls.select("class", F.col("class").alias("new_class")))
        old = None
        if self.filled:
            before = found.where("NOT is_new").drop("is_new")
            # a new class that differs from a stored one, and one that is stored itself
            theirs = self.probe("classes", before.select("class").unionByName(cls.select("class")))
            held = verify(before.where("class <> new_class"), theirs, cls).unionByName(cls.select("class", F.col("class").alias("new_class")))
            by_text = rows.select("entry_no", F.col("class").alias("new_class")).join(held.join(theirs.select("class", "kept_no"), "class"), "new_class").select("kept_no", "entry_no")
            by_id = rows.select("entry_no", "id_key").join(self.probe("ids", rows.where("id_key IS NOT NULL")), "id_key").select("kept_no", "entry_no")
            old = self._save(by_text.unionByName(by_id).distinct(), "old")
        pairs = self._decide(rows, both, old)
        self.append(rows.join(pairs.select("entry_no"), "entry_no", "left_anti"))
        return pairs

    def _decide(self, rows: DataFrame, near: DataFrame, old: DataFrame | None) -> DataFrame:
        """Rounds over the verified pairs: a row is kept if no earlier undecided row could be its original, and repeats if one of them is kept."""
        start = rows.select("entry_no", "class", "id_key")
        left = start if old is None else start.join(old.select("entry_no").distinct(), "entry_no", "left_anti")
        kept: list[DataFrame] = []
        while True:
            first = left.where("class IS NOT NULL").groupBy("class").agg(F.min("entry_no").alias("kept_no"))
            by_text = left.withColumnRenamed("class", "new_class").join(near.join(first, "class"), "new_class").select("kept_no", "entry_no")
            first_id = left.where("id_key IS NOT NULL").groupBy("id_key").agg(F.min("entry_no").alias("kept_no"))
            edges = by_text.unionByName(left.join(first_id, "id_key").select("kept_no", "entry_no")).where("kept_no < entry_no")
            edges = self._save(edges.distinct(), "edges")
            waits = edges.select("entry_no").distinct()
            kept.append(self._save(left.join(waits, "entry_no", "left_anti"), "kept"))
            done = edges.join(kept[-1].select(F.col("entry_no").alias("kept_no")), "kept_no", "left_semi").select("entry_no")
            left = self._save(left.join(waits, "entry_no", "left_semi").join(done.distinct(), "entry_no", "left_anti"), "open")
            if left.isEmpty():
                break
        accepted = kept[0]
        for k in kept[1:]:
            accepted = accepted.unionByName(k)
        accepted = accepted.withColumnRenamed("entry_no", "kept_no")
        repeated = start.join(accepted.select(F.col("kept_no").alias("entry_no")), "entry_no", "left_anti")
        by_text = repeated.withColumnRenamed("class", "new_class").join(near, "new_class").join(accepted.select("class", "kept_no"), "class").select("kept_no", "entry_no")
        by_id = repeated.join(accepted.select("id_key", "kept_no"), "id_key").select("kept_no", "entry_no")
        pairs = by_text.unionByName(by_id).where("kept_no < entry_no")
        return self._save((pairs if old is None else pairs.unionByName(old)).distinct(), "pairs")


def repeats(entries: DataFrame, root: str | None = None) -> DataFrame:
    """p2_found: (kept_no, dup_no). The history (batch 0) fills the index; what waits (all later batches) is then taken against it."""
    index = SegmentIndex(entries.sparkSession, root)
    later = F.coalesce(F.col("batch_no") > 0, F.lit(True))
    pairs = [index.take(entries.where(~later)), index.take(entries.where(later))]
    return pairs[0].unionByName(pairs[1]).select("kept_no", F.col("entry_no").alias("dup_no"))
