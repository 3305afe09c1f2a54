"""Connected components and cluster records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the least id of each node's component; nodes without edges are components of their own.

    Alternating large-star and small-star steps on the edge list (Kiveris et al. 2014): a few rounds even for long chains, each
    written to the shared folder. Edges are (src, dst); loops, repeated edges and NULL ends are ignored.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    label = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("cluster"))
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def stars(df: DataFrame, key: str, node: str) -> DataFrame:
    """Edges from each group's least member to its others; NULL keys and the word null form no group."""
    d = df.where(F.col(key).isNotNull() & ~F.col(key).isin("", "null")).select(F.col(node).alias("dst"), key)
    return d.join(d.groupBy(key).agg(F.min("dst").alias("src")), key).where("src <> dst").select("src", "dst")


def records(comp: DataFrame, triggers: DataFrame) -> DataFrame:
    """Cluster records: (cluster, cluster_id, size, n_triggers), numbered by size and least member. Clusters without trigger are left out, but use up their number."""
    n = comp.groupBy("cluster").agg(F.count("*").alias("size"))
    # Numbering needs the sizes only: ranks inside each size are added to the count of clusters of larger sizes.
    sizes = n.groupBy("size").agg(F.count("*").alias("k"))
    base = sizes.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("size", "base")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("cluster"))
    t = comp.join(triggers.select("id").distinct(), "id", "left_semi").groupBy("cluster").agg(F.count("*").alias("n_triggers"))
    out = n.join(base, "size").withColumn("cluster_id", F.format_string("c%03d", F.col("base") + rank))
    return out.join(t, "cluster").select("cluster", "cluster_id", "size", "n_triggers")


def members(comp: DataFrame, triggers: DataFrame, scores: DataFrame) -> DataFrame:
    """The members of the clusters that have a trigger, a row each, so that no record holds a whole cluster: (cluster, id, is_trigger, best_score).

    ``best_score`` is the best score, to three digits, of a pair (trigger, member), in this direction or, where it is missing or zero, in the other; NULL if there is none.
    """
    t = triggers.select("id").distinct().withColumn("is_trigger", F.lit(True))
    marked = comp.join(t, "id", "left").withColumn("is_trigger", F.coalesce("is_trigger", F.lit(False)))
    some = marked.where("is_trigger").select("cluster").distinct()
    there = scores.select(F.col("src").alias("t"), F.col("dst").alias("id"), "score")
    back = scores.select(F.col("dst").alias("t"), F.col("src").alias("id"), F.col("score").alias("reverse"))
    pair = there.join(back, ["t", "id"], "full").select("t", "id", F.coalesce(F.nullif("score", F.lit(0.0)), "reverse").alias("s"))
    best = pair.join(t.select(F.col("id").alias("t")), "t", "left_semi").groupBy("id").agg(F.round(F.max("s"), 3).alias("best_score"))
    return marked.join(some, "cluster", "left_semi").join(best, "id", "left").select("cluster", "id", "is_trigger", "best_score")
