"""Mixing sources to target weights along a time-varying curriculum.

A source's schedule is a piecewise-linear weight over training time [0, 1].
Its integral is the source's weight; weights share out the word budget, a
source stops at ``max_repeats`` times its own size and the excess goes to the
others by weight.  Within a source documents stand in a keyed order; their
running word count is laid on the source's cumulative demand, and inverting
the demand gives each copy its training position.  Documents are then
range-sorted by position.

Running counts are distributed: keyed order splits every source into about
sqrt(rows) buckets, bucket totals are summed first, and a bucket's rows are
summed inside it, so a source with a third of all rows is many small groups.
The table of sources has one row per source and is the only thing that is
ranked in one place.

Cases: null text has size 0; a null source is a source of its own and comes
last; documents of size 0 are never taken; rows that repeat an id follow each
other by size and text; an empty table gives an empty mix.  Documents are taken
whole: the last one that a source's demand reaches is taken if that comes nearer
to the target than leaving it, so what is taken differs from the target by half
a document at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, at, positional, take, write_shared

#: Weight shapes over training time, each with integral 1: (time, factor) knots.
EARLY = [(0.0, 1.5), (1.0, 0.5)]
STEADY = [(0.0, 1.0), (1.0, 1.0)]
LATE = [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]
#: Weights by a source's rank, repeating.
CYCLE = [(5.0, EARLY), (2.0, STEADY), (1.0, LATE)]
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _schedule(rank: Column, cycle=CYCLE) -> Column:
    """Struct of knot times t, weights w and running integrals d."""
    arms = []
    for weight, knots in cycle:
        t, w = [k[0] for k in knots], [weight * k[1] for k in knots]
        d = [0.0]
        for i in range(1, len(t)):
            d.append(d[-1] + (w[i] + w[i - 1]) / 2 * (t[i] - t[i - 1]))
        arms.append(F.struct(*[F.array(*[F.lit(float(x)) for x in xs]).alias(n) for n, xs in zip("twd", (t, w, d))]))
    out = arms[-1]
    for i in range(len(arms) - 2, -1, -1):
        out = F.when(rank % len(arms) == i, arms[i]).otherwise(out)
    return out


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: float = 2.0, cycle=CYCLE) -> DataFrame:
    """(source, source_size) -> also schedule s, weight, target.

    The water level ``budget per weight`` starts with every source open; those
    whose limit lies below their share close at it and the level is taken
    again, until no source is above its limit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = (sizes.withColumn("s", _schedule(rank, cycle)).withColumn("weight", F.element_at("s.d", -1))
         .withColumn("limit", F.col("source_size") * max_repeats))
    s = write_shared(s, "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, closed = math.inf, -1
    while True:
        shut = F.lit(False) if closed < 0 else F.col("limit") <= F.lit(level) * F.col("weight")
        row = s.agg(F.sum(F.when(shut, F.col("limit"))), F.sum(F.when(~shut, F.col("weight"))),
                    F.count(F.when(shut, 1))).first()
        if row[2] == closed:
            break
        closed = row[2]
        if not row[1]:  # every source is at its limit
            level = math.inf
            break
        level = (total * share - (row[0] or 0.0)) / row[1]
    want = F.col("limit") if math.isinf(level) else F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", want).drop("limit")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a tie-break of every row, in a written table."""
    return write_shared(take(docs, "doc_id", "source", "text").select(
        "doc_id", "source", words(F.col("text")).alias("size"), _tie(F.col("text")).alias("tie")), "measured")


def _tie(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _keyed(rows: DataFrame, seed: str, buckets: int | None = None) -> DataFrame:
    # The text is in it, so that rows without an id, or with one id, are many buckets.
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "tie")))
    if buckets is None:
        return rows
    return rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0 ** 32)))


def assign(rows: DataFrame, slim: DataFrame, share: float = 1.5, max_repeats: int = 2, cycle=CYCLE,
           seed: str = SEED) -> DataFrame:
    """``rows``: doc_id, source, size, tie (hash of the text); other columns pass through.
    ``slim``: the same rows without those, for the counts (:func:`measured`).

    Adds source_size, target, taken (words, repeats counted) and copies: an
    array of (position, words), one for each time the document is taken.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    src = write_shared(targets(sizes, share, max_repeats, cycle), "targets")
    n = src.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.isqrt(n))
    # Bucket totals, then where each bucket begins in its source's order.
    tot = write_shared(
        _keyed(slim, seed, buckets).groupBy("source", "bucket").agg(F.sum("size").alias("b"))
        .withColumn("begin", F.sum("b").over(Window.partitionBy("source").orderBy("bucket")) - F.col("b"))
        .select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), "begin"), "buckets")
    src = src.select(F.col("source").alias("of"), "source_size", "target", "s")
    local = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "tie")
    r = _keyed(rows, seed, buckets)
    r = r.withColumn("run", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    r = r.join(tot, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("bkt")))
    r = r.join(src, F.col("source").eqNullSafe(F.col("of")))
    at0 = F.col("begin") + F.col("run")

    def got(e: Column) -> Column:
        room = F.col("target") - (e * F.col("source_size") + at0)
        return F.when(room * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))

    def copy(e: Column) -> Column:
        mid = (e * F.col("source_size") + at0 + got(e) / 2.0) / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(invert(F.col("s"), mid).alias("position"), got(e).alias("words"))

    epochs = F.array(*[F.lit(e).cast("long") for e in range(max_repeats)])
    return (r.withColumn("copies", F.filter(F.transform(epochs, copy), lambda c: c["words"] > 0))
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
            .drop("h", "bucket", "run", "src", "bkt", "begin", "s", "of"))


def invert(s: Column, share: Column) -> Column:
    """Time at which the schedule has used ``share`` of its integral."""
    y = share * F.element_at(s["d"], -1)
    k = F.greatest(F.lit(1), F.least(F.size(s["d"]) - 1, F.size(F.filter(s["d"], lambda d: d <= y))))
    t0, t1 = F.element_at(s["t"], k), F.element_at(s["t"], k + 1)
    w0, w1 = F.element_at(s["w"], k), F.element_at(s["w"], k + 1)
    r = y - F.element_at(s["d"], k)
    slope = (w1 - w0) / (t1 - t0)
    root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * r))
    return F.least(t1, F.when(r <= 0, t0).otherwise(t0 + 2 * r / (w0 + root)))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, one row per copy, sorted by position; columns and texts as in ``docs``."""
    p, names = positional(docs)
    text = at(names, "text")
    p = p.select("*", at(names, "doc_id").alias("doc_id"), at(names, "source").alias("source"),
                 words(text).alias("size"), _tie(text).alias("tie"))
    m = assign(p, measured(docs), **how).select(*[f"_c{i}" for i in range(len(names))], F.explode("copies.position").alias("position"))
    return m.repartitionByRange("position").sortWithinPartitions("position").drop("position").toDF(*names)
