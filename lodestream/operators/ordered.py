"""Ordered prefix sums that no single task has to compute for a whole hot key.

A key's rows are cut into time buckets; each bucket is scanned alone, the few bucket totals of a key are
summed in order, and the two are added. A key with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, key: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the inclusive running sum of its column along ``order`` within ``key``.

    ``order`` must be a total order that rises with ``bucket``. NULL keys form one key of their own.
    """
    b = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()})
    totals = b.groupBy(*key, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})
    inner = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = b.withColumns({n: F.sum(f"_v_{n}").over(inner) for n in sums})
    t = totals.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_bucket").alias("_k_bucket"), *[f"_b_{n}" for n in sums])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key] + [F.col("_bucket").eqNullSafe(F.col("_k_bucket"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = run.join(t, cond, "left").withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_bucket", "_k_bucket", *[f"_k_{k}" for k in key], *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])
