"""Structured Streaming counterparts of the batch jobs.

* ``daily_revenue_stream``: events -> watermark -> 1-day tumbling windows per
  event type (append mode, state bounded by the watermark).
* ``ingest_stream``: a landing folder of order CSVs processed with
  ``trigger(availableNow=True)``: keyed state holds the first row of every key,
  each micro-batch writes the keys it changed and an action log (idempotent per
  batch id); the snapshot is their merge.

Sinks and checkpoints live under the session's ``spark.checkpoint.dir``, so
a restarted query resumes from its offsets (exactly-once file sinks).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning as CL
from ..operators import ingest as IN
from ..session import path_exists, shared_path


def stream_root(spark: SparkSession, name: str, tag: str) -> str:
    return shared_path(spark, "streams", name, tag)


def daily_revenue_stream(spark: SparkSession, events_path: str, out: str, checkpoint: str,
                         watermark: str = "1 day") -> None:
    """Run to completion over what is available (availableNow)."""
    schema = spark.read.parquet(events_path).schema
    src = events_path
    if not os.path.isdir(events_path):
        # The file stream source lists folders; a one-character glob class
        # turns a single file into a pattern it can list.
        d, b = os.path.split(events_path)
        src = os.path.join(d, f"[{b[0]}]{b[1:]}")
    s = spark.readStream.schema(schema).parquet(src)
    ev = s.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = (ev.withWatermark("ts", watermark)
           .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
           .agg(F.count("*").alias("events"),
                F.sum(F.col("value").cast("decimal(12,2)")).alias("value")))
    rows = agg.select(F.col("w.start").cast("timestamp_ntz").cast("date").alias("day"), "event_type", "events",
                      F.col("value").cast("double").alias("value"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # Update mode: each batch carries the windows it changed; the batch id
        # lets readers keep the latest version of every window.
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(out, f"batch={batch_id}"))

    q = (rows.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """Latest version of each (day, event_type) window across batches."""
    log = spark.read.parquet(out)
    return (log.groupBy("day", "event_type")
            .agg(F.max_by(F.struct("events", "value"), F.col("batch_id")).alias("v"))
            .select("day", "event_type", "v.events", "v.value"))


ORDER_FIELDS = ["order_id_stage", "customer_id_stage", "order_date", "order_status", "payment_method_group",
                "order_total_amount", "ingest_pos"]


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _changes(rows: DataFrame) -> DataFrame:
    """Keep-first state of a stream of order rows, as what a micro-batch changes:
    ``kind`` 0, a key with its first row so far and the time of the batch that
    brought the key; ``kind`` 1, the number of rows of a batch, by its time.

    A batch's time is fixed when the batch is planned and kept in the checkpoint,
    so a replayed batch has the same one."""
    rest = [c for c in ORDER_FIELDS if c not in ("order_id_stage", "ingest_pos")]
    first = F.struct("ingest_pos", *rest)
    t = rows.withColumn("at", F.current_timestamp()).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    t = t.filter((F.col("kind") == 1) | F.col("order_id_stage").isNotNull())
    key = [F.col("kind"), F.when(F.col("kind") == 0, F.col("order_id_stage")).alias("order_id_stage"),
           F.when(F.col("kind") == 1, F.col("at")).alias("batch_at")]
    return t.groupBy(*key).agg(F.min(F.when(F.col("kind") == 0, first)).alias("first"), F.count("*").alias("n"), F.min("at").alias("since"))


def ingest_stream(spark: SparkSession, landing: str, snapshot_dir: str, log_dir: str, checkpoint: str,
                  files_per_batch: int = 64) -> None:
    """Incremental order loads from CSV files in ``landing``; each micro-batch
    takes up to ``files_per_batch`` new files.

    Keep-first per key over the whole load: of all rows of a key the one with
    the smallest ``ingest_pos`` (then the smallest content) is the stored one,
    the others are rejected.  That minimum does not depend on how files fall
    into micro-batches, nor does the log: the first row of a key to arrive is
    logged as inserted, every other one (and each null key) as rejected.

    What earlier batches stored is known from keyed state (one row a key: its
    first row and when it came), which Spark keeps in the checkpoint and updates
    by the keys of a batch.  So a batch shuffles its own rows and costs the same
    however many came before.  It writes the keys it changed into a folder of
    its own (``batch=n``) and logs from that; nothing stored before is read or
    rewritten.  :func:`snapshot` merges the folders.  A replayed batch starts
    from the state of the batch before and rebuilds its folders; a batch whose
    predecessor's folder is gone is an error.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ORDER_FIELDS])
    if not spark.conf.get(STATE_STORE, None) or "RocksDB" not in spark.conf.get(STATE_STORE):
        spark.conf.set(STATE_STORE, ROCKSDB)  # state beyond an executor's memory
    src = (spark.readStream.schema(schema).option("header", True)
           .option("maxFilesPerTrigger", files_per_batch).csv(landing))
    rows = CL.repair_ids(src).select(
        "order_id_stage", "customer_id_stage", "order_date", "order_status", "payment_method_group",
        F.col("order_total_amount").try_cast("decimal(12,2)").alias("order_total_amount"),
        F.col("ingest_pos").try_cast("int").alias("ingest_pos"))

    def load(batch: DataFrame, batch_id: int) -> None:
        bs = batch.sparkSession
        before = os.path.join(snapshot_dir, f"batch={batch_id - 1}")
        if batch_id and not path_exists(bs, before):
            raise FileNotFoundError(f"{before}: the snapshot lacks the batch before {batch_id}")
        mine = os.path.join(snapshot_dir, f"batch={batch_id}")
        batch.write.mode("overwrite").parquet(mine)  # evaluated once: it moves the state
        done = bs.read.schema(batch.schema).parquet(mine)
        now = done.filter("kind = 1").agg(F.max("batch_at").alias("at"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        new = done.filter("kind = 0").select("since").join(now, F.col("since") == F.col("at")).agg(F.count("*").alias("inserted"))
        log = new.select("inserted", (now.select("rows").scalar() - F.col("inserted")).alias("rejected"))
        (log.unpivot([], ["inserted", "rejected"], "action", "records")
         .write.mode("overwrite").parquet(os.path.join(log_dir, f"batch={batch_id}")))

    q = (_changes(rows).writeStream.outputMode("update").foreachBatch(load).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def snapshot(spark: SparkSession, snapshot_dir: str) -> DataFrame:
    """The stored orders: per key the first row over all batches."""
    rows = spark.read.parquet(snapshot_dir).filter("kind = 0").select("order_id_stage", "first.*").select(*ORDER_FIELDS)
    return IN.accepted(rows, "order_id_stage", ["ingest_pos"])
