"""Incremental column profile from mergeable sketches (O-2.5, O-2.7, O-2.13).

A load profiles its own rows only and stores, for each column, counts, extremes
and two sketches; reading merges them, so the profile of all loads never reads
earlier rows again.  The exact queries in :mod:`.profile` stay what reports use
where one pass over everything is affordable.

Errors: distinct values by HyperLogLog with 2^12 registers, a standard error of
1.6 % (``DISTINCT_ERROR``, three of them, is what tests hold it to); quantiles by
a KLL sketch, whose value's rank is within 1.65 % of the wanted one
(``RANK_ERROR``).  Counts, missing values, minima and maxima are exact.  A merged
sketch has the error of one over all rows.

A stored profile is one folder a load: a repeated load replaces its own.  One
aggregation over the load's rows; a sketch is a few kilobytes, and merging holds
one sketch a column and load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERS = 12
DISTINCT_ERROR = 0.05
RANK_ERROR = 0.0165
#: Digits with an optional sign, point and exponent; names of infinities and NaN are no numbers.
NUMBER = r"^\s*[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
#: A number begins with white space, a sign, a point or a digit; all of them sort before this.
AFTER_NUMBERS = ":"

SCHEMA = ("column string, load string, rows long, missing long, low double, high double, n_numbers long, "
          "distinct_sketch binary, rank_sketch binary")


def profile(df: DataFrame, load: Column, columns: list[str] | None = None) -> DataFrame:
    """One row for each load and column of ``df`` (``load``: names the load of a row; null counts as empty)."""
    cols = columns or df.columns
    cells, aggs = [], []
    for i, c in enumerate(cols):
        text, v, x = F.col(f"`{c}`").cast("string"), F.col(f"v{i}"), F.col(f"x{i}")
        # Only what looks like a number is cast: a failed cast costs an exception a cell.
        # A cell is looked at once, in a projection before the aggregates that share it;
        # what begins with a letter is known by one comparison.
        cells += [text.alias(f"v{i}"), F.when((text < AFTER_NUMBERS) & text.rlike(NUMBER), text.try_cast("double")).alias(f"x{i}")]
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), F.hll_sketch_agg(v, F.lit(REGISTERS)).alias(f"d{i}"), F.min(x).alias(f"a{i}"),
                 F.max(x).alias(f"b{i}"), F.count(x).alias(f"n{i}"), F.kll_sketch_agg_double(x).alias(f"q{i}")]
    g = df.select(F.coalesce(load.cast("string"), F.lit("")).alias("load"), *cells).groupBy("load").agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), "load", "rows", F.col(f"m{i}").alias("missing"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"),
                              F.col(f"n{i}").alias("n_numbers"), F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("rank_sketch"))
                     for i, c in enumerate(cols)])
    return g.select(F.explode(each).alias("x")).select("x.*")


def append(df: DataFrame, path: str, load: Column, columns: list[str] | None = None) -> None:
    """Store the profiles of the loads in ``df``; a load that is there already is replaced."""
    (profile(df, load, columns).repartition("load").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged(stored: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Per column over all loads: rows, missing, distinct_values (estimate), low, high, n_numbers and quantiles (estimates, null
    without numbers)."""
    sketches = F.filter(F.collect_list(F.when(F.col("n_numbers") > 0, F.col("rank_sketch"))), lambda s: s.isNotNull())
    g = stored.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_numbers").alias("n_numbers"), sketches.alias("_s"))
    one = F.aggregate(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), F.get("_s", F.lit(0)), lambda a, s: F.kll_sketch_merge_double(a, s))
    g = g.withColumn("_q", F.when(F.size("_s") > 0, one))
    return g.select("column", "rows", "missing", "distinct_values", "low", "high", "n_numbers",
                    F.array(*[F.when(F.col("_q").isNotNull(), F.kll_sketch_get_quantile_double("_q", F.lit(float(p)))) for p in probs]).alias("quantiles"))
