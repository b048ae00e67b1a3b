"""Registered streaming queries: each runs its stream to completion
(availableNow) into a sink under the checkpoint folder and returns the sink
read back as a batch DataFrame."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from ..session import table_path
from ..streaming import jobs as SJ
from .q_files import _landing
from .registry import register


def _tag(sf: str) -> str:
    return hashlib.sha1(os.path.abspath(sf).encode()).hexdigest()[:12] + "-" + uuid.uuid4().hex[:8]


@register("stream_daily_revenue", """
    SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
           sum(CAST(value AS DECIMAL(12,2)))::DOUBLE AS value
    FROM events GROUP BY 1, 2""")
def stream_daily_revenue(spark, sf):
    """Watermarked 1-day windows over the event stream (all windows close
    at the end of an availableNow run)."""
    root = SJ.stream_root(spark, "daily_revenue", _tag(sf))
    out, ck = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    SJ.daily_revenue_stream(spark, table_path(sf, "events"), out, ck)
    return SJ.latest_windows(spark, out)


@register("stream_ingest_orders", """
    SELECT 'inserted' AS action, count(DISTINCT order_id_stage)::BIGINT AS records FROM raw_orders_c
    UNION ALL SELECT 'rejected', (count(*) - count(DISTINCT order_id_stage))::BIGINT FROM raw_orders_c
    UNION ALL SELECT 'stored', count(DISTINCT order_id_stage)::BIGINT FROM raw_orders_c""", "raw_orders_c")
def stream_ingest_orders(spark, sf):
    """Landing order files loaded micro-batch by micro-batch: the action log
    summed over batches, and the number of keys in the merged snapshot."""
    landing = os.path.join(_landing(spark, sf, ["orders"]), "orders")
    root = SJ.stream_root(spark, "ingest_orders", _tag(sf))
    snap, log = os.path.join(root, "snapshot"), os.path.join(root, "log")
    SJ.ingest_stream(spark, landing, snap, log, os.path.join(root, "checkpoint"))
    acts = spark.read.parquet(log).groupBy("action").agg(F.sum("records").cast("bigint").alias("records"))
    stored = SJ.snapshot(spark, snap).agg(F.lit("stored").alias("action"), F.count("*").alias("records"))
    return acts.unionByName(stored)
