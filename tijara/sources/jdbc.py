"""Relational source and sink (O-1.3, O-1.6) through Spark's JDBC data source.

Connection settings (URL, user, password, driver) come from the caller's
configuration; nothing is embedded here.  Reads are split into parallel
range partitions on a numeric or date column so a large table is not pulled
through one connection; writes append in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, columns: list[str] | None = None,
               partition_column: str | None = None, lower=None, upper=None, num_partitions: int = 64,
               fetch_size: int = 10000, **props) -> DataFrame:
    """``SELECT cols FROM table`` as a partitioned JDBC scan; the projection
    is pushed to the database, later filters are pushed by Spark."""
    query = table if not columns else f"(SELECT {', '.join(columns)} FROM {table}) t"
    r = spark.read.format("jdbc").option("url", url).option("dbtable", query).option("fetchsize", fetch_size)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", num_partitions))
    for k, v in props.items():
        r = r.option(k, v)
    return r.load()


def append_table(df: DataFrame, url: str, table: str, batch_size: int = 10000,
                 num_partitions: int | None = None, **props) -> None:
    """Append sink (the source's ``to_sql(if_exists='append')``); key
    conflicts are resolved before writing by the upsert classification."""
    out = df if num_partitions is None else df.coalesce(num_partitions)
    w = out.write.format("jdbc").mode("append").option("url", url).option("dbtable", table) \
        .option("batchsize", batch_size)
    for k, v in props.items():
        w = w.option(k, v)
    w.save()
