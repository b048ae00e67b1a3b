"""Session helpers.

The library never creates a cluster session on its own; jobs receive a
``SparkSession``.  ``local_session`` exists for tests and the bench, and the
configuration it sets is the one we want on a cluster too: AQE with
partition coalescing and skew-join splitting, UTC session time, no UI.
"""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on (also applied to a session handed to us when unset).
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partial aggregation must stay on: it is what makes a hot group key cheap.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tijara") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a purely local
    session (``local[...]``, where driver and executors are one process) may
    leave it unset; then a scratch folder is picked.  On a cluster an unset
    folder is an error: a machine-local folder would not be shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tijara-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    # RDD-level checkpointing (DataFrame.checkpoint) reads the context setting.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder that belongs to this application alone."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "tijara", spark.sparkContext.applicationId, *parts])


_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
_spare_lock = threading.Lock()
_spared: dict[int, tuple[int, dict]] = {}  # session -> open blocks, settings before the first


@contextmanager
def disk_spared(spark: SparkSession):
    """What a write in this block shuffles is deleted when the write ends, not
    when the driver next collects garbage (nothing reads it again), and Parquet
    is written with zstd: for jobs that move or write wide tables."""
    at = id(spark)
    with _spare_lock:
        n, was = _spared.get(at) or (0, {k: spark.conf.get(k, None) for k in _SPARING})
        _spared[at] = n + 1, was
        for k, v in _SPARING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _spare_lock:
            n, was = _spared.pop(at)
            if n > 1:
                _spared[at] = n - 1, was
            else:
                for k, v in was.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the application's shared folder and read it
    back: cuts lineage, survives executor loss, and each call gets its own path."""
    spark = df.sparkSession
    path = shared_path(spark, "tables", f"{label}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tijara`` importable on executors (grouped-map / mapInPandas
    functions reference it).  The zip goes to the shared folder through the
    Hadoop file system, so a folder given as URI works, and every executor
    fetches it from there (``addPyFile``)."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _shipped:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("tijara", os.path.relpath(full, pkg)))
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "pyfiles", "tijara.zip"))
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _shipped.add(app)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (works for
    local, HDFS and object-store paths alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
