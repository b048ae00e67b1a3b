"""Exact quantiles of any number of values, distributed.

Values are counted (a partial aggregation, so repeated values shrink first),
the counts are range-sorted by (keys, value), and ranks follow from totals per
range: no task holds a column or a key's values, and the result does not
depend on partitioning or size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: list[float], linear: bool) -> DataFrame:
    """``keys`` (never null) and ``q``: array of the quantiles of the non-null
    values.  ``linear`` interpolates between neighbours; otherwise a quantile is
    the value at rank ceil(p * n)."""
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    k = [F.col(c).alias(n) for c, n in zip(keys, names)] or [F.lit(0).alias("_k0")]
    counts = df.select(*k, value.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    counts = write_shared(counts.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()), "value-counts")
    # One row for each range and key that occurs in it.
    before = Window.partitionBy(*names).orderBy("_part")
    parts = (counts.groupBy("_part", *names).agg(F.sum("_c").alias("_t"))
             .withColumn("_before", F.sum("_t").over(before) - F.col("_t"))
             .withColumn("_n", F.sum("_t").over(Window.partitionBy(*names))).drop("_t"))
    local = Window.partitionBy("_part", *names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = (counts.withColumn("_run", F.sum("_c").over(local)).join(parts, ["_part", *names])
          .withColumn("_end", F.col("_before") + F.col("_run")).withColumn("_begin", F.col("_end") - F.col("_c")))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        if linear:
            pos = (F.col("_n") - 1) * F.lit(p)
            return F.floor(pos), F.ceil(pos), pos - F.floor(pos)
        r = F.greatest(F.ceil(F.col("_n") * F.lit(p)) - 1, F.lit(0))
        return r, r, F.lit(0.0)

    def pick(r: Column) -> Column:
        return F.max(F.when((F.col("_begin") <= r) & (r < F.col("_end")), F.col("_v")))

    cols = []
    for i, p in enumerate(probs):
        lo, hi, part = ranks(p)
        cols += [pick(lo).alias(f"_lo{i}"), pick(hi).alias(f"_hi{i}"), F.max(part).alias(f"_f{i}")]
    got = at.groupBy(*names).agg(*cols)
    lo, hi, part = ([F.col(f"_{n}{i}") for i in range(len(probs))] for n in ("lo", "hi", "f"))
    q = [F.when(a == b, a).otherwise(a * (1 - f) + b * f) if linear else a for a, b, f in zip(lo, hi, part)]
    return got.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], F.array(*q).alias("q"))
