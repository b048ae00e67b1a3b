"""Every registered query works on whole tables: a limit appears only where it
is the feature (top-n reports, a fixed-order sample, a preview, the first
dataset with a date range) and no query samples rows."""
import datetime as dt
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tijara.operators import regions as R

LIMIT_IS_THE_FEATURE = {"top_products", "low_products", "top_product", "top_products_list", "top_pages",
                        "rule_violation_sample", "preview_redacted", "date_coverage",
                        "run_history"}  # embeds date_coverage (first dataset with a date range)
OWN = re.compile(r"op\d+_|pipeline$")  # tested in tests/llm
SKIP = {"stream_daily_revenue", "stream_ingest_orders", "csv_quality", "csv_roundtrip", "web_export_channels",
        "header_detection", "batch_validation"}


def test_limits_only_where_they_are_the_feature(spark):
    offenders = []
    for name, fn in E.queries().items():
        if name in SKIP or OWN.match(name):
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        has_limit = "GlobalLimit" in plan or "LocalLimit" in plan or "Tail" in plan
        if "Sample" in plan or (has_limit and name not in LIMIT_IS_THE_FEATURE):
            offenders.append(name)
    assert offenders == []


def test_month_offsets_clamp_to_month_end(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 5, 31, 10, 30),)], "d timestamp_ntz")
    out = df.select(R.months_before(F.col("d"), 3).alias("a"), R.months_before(F.col("d"), 6).alias("b")).first()
    assert out.a == dt.datetime(2026, 2, 28, 10, 30) and out.b == dt.datetime(2025, 11, 30, 10, 30)


def test_complete_month_cutoff(spark):
    df = spark.createDataFrame([(dt.date(2001, 8, 1),), (dt.date(2001, 7, 31),), (dt.date(2024, 2, 29),)], "d date")
    got = [r.c for r in df.select(R.complete_month_cutoff(F.col("d")).alias("c")).collect()]
    assert got == [dt.date(2001, 7, 1), dt.date(2001, 7, 1), dt.date(2024, 2, 1)]
