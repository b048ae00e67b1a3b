"""Exact dedup by a heavy-hitter split (DataFrame functions only).

1. One pass turns every text into the SHA-256 of its normalised form (each run
   of white space is one space); only ids and digests go on.
2. A Misra-Gries summary (Spark's ``freqItems``) names the digests that may
   hold more than a share ``support`` of the rows, at most ``1 / support`` of
   them; a second count verifies them and finds each one's winner.
3. The verified winners are broadcast and heavy rows are decided map-side. All
   other digests are grouped by an ordinary shuffle; after the split no group
   there holds more than ``support`` of the rows.

The bound on what is broadcast is ``1 / support`` rows of about 60 bytes,
whatever the input size.

Cases: a null text counts as empty; null ids come after all others, so a row
without an id stays only where its whole group has none (``keep_id`` is null
then); of rows that repeat id and text one stays; an empty table gives an
empty result; columns besides ``doc_id`` and ``text`` never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_decided, take, write_shared

SUPPORT = 0.001


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def decide(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    slim = write_shared(
        take(docs, "doc_id", "text").select("doc_id", digest(F.col("text")).alias("digest"),
                                            F.monotonically_increasing_id().alias("uid")), "digests")
    rows = slim.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("w")
    group = [F.count("*").alias("group_size"), first]

    frequent = (slim.stat.freqItems(["digest"], support)
                .select(F.explode(F.col("digest_freqItems")).alias("digest")))
    heavy = write_shared(slim.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*group)
                         .filter(F.col("group_size") >= support * rows), "heavy")
    split = slim.join(F.broadcast(heavy), "digest", "left")
    hot = split.filter(F.col("group_size").isNotNull())
    rest = split.filter(F.col("group_size").isNull()).drop("group_size", "w")
    repeated = rest.groupBy("digest").agg(*group).filter("group_size > 1")
    rest = rest.join(repeated, "digest", "left")
    return (hot.unionByName(rest)
            .select("doc_id", "digest",
                    F.when(F.col("w").isNull(), F.col("doc_id")).otherwise(F.col("w.doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("uid") == F.col("w.uid"), F.lit(True)).alias("kept")))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    d = decide(docs, support).filter("group_size > 1").select("doc_id", F.col("digest").alias("key"), "kept")
    return keep_decided(docs, write_shared(d, "decided"), digest)
