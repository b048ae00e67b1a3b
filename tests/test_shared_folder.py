"""The shared folder may be a URI, and a cluster must name one."""
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tests.conftest import SF_SMALL
from tijara import session as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate())
import __spark_entry__ as E
E.entry(spark).collect()
Q = E.queries()
for name in ("fc_arima_ma", "csv_quality", "stream_ingest_orders"):
    assert Q[name](spark, sys.argv[3]).collect(), name
"""


def test_checkpoint_folder_as_uri(tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared"), SF_SMALL], cwd=work, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not (work / "file:").exists() and not os.path.exists(os.path.join(ROOT, "file:"))
    assert (tmp_path / "shared" / "tijara").is_dir()


def test_a_cluster_must_name_a_shared_folder():
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        S.ensure_checkpoint_dir(SimpleNamespace(conf={}, sparkContext=sc))
