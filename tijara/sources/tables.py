"""Parquet table access and size-checked broadcast.

Reads are lazy: Catalyst prunes columns and pushes filters into each scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


class Tables:
    """``Tables(spark, dir).orders`` -> DataFrame of ``dir/orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise AttributeError(name)
        # One relation per (session, path): the file listing of a large table
        # happens once per session instead of once per query.
        key = (self.spark.sparkContext.applicationId, table_path(self.sf_dir, name))
        df = _relations.get(key)
        if df is None:
            df = self.spark.read.parquet(key[1])
            _relations[key] = df
        return df


_relations: dict[tuple[str, str], DataFrame] = {}


_bound_checked: dict[tuple[str, str], bool] = {}


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after proving it holds at most ``max_rows`` rows.

    The check runs ``limit(max_rows + 1).count()`` once per plan and session;
    when the bound is exceeded the frame is returned unhinted and AQE picks
    the join strategy from runtime statistics instead.
    """
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash().__str__())
    ok = _bound_checked.get(key)
    if ok is None:
        ok = df.limit(max_rows + 1).count() <= max_rows
        _bound_checked[key] = ok
    return F.broadcast(df) if ok else df
