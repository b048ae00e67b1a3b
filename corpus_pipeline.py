"""Corpus pipeline over ``documents``: toxic documents go, one of each group of
equal and of near-equal documents stays, sources are mixed to their targets,
and the mix is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
caller writes as Parquet and hands to the next stage.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tijara.llm import exact_dedup, mixing, packing, simhash, toxicity
from tijara.llm.common import prepare, read, write_shared


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; learned from the labels' learning folds."""
    prepare(spark)
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    prepare(spark)
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits) stays."""
    prepare(spark)
    return simhash.near_dedup(docs, n=3, d=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    prepare(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix with their sequence and place."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixed),
          ("best-fit packing", packed)]

#: Learned scores, XXH64 fingerprints and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_shared(docs, "stage-" + name.replace(" ", "-"))
    return docs
