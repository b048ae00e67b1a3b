"""Journeys against loops: ties, hot users, every cut into tasks and batches."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tijara.operators import journey as J


def brute(rows):
    by, reached, pairs = {}, Counter(), Counter()
    for u, t, s in rows:
        if u is not None and t is not None and s in J.STEPS:
            by.setdefault(u, []).append((t, J.STEPS.index(s)))
    for ev in by.values():
        ev.sort()
        before, k = -1, 0
        while k < 4:
            later = [t for t, s in ev if s == k and t >= before]
            if not later:
                break
            before, k = min(later), k + 1
        for i in range(k):
            reached[J.STEPS[i]] += 1
        for (t, a), (t2, b) in zip(ev, ev[1:]):
            pairs[J.STEPS[a], J.STEPS[b]] += np.array([1, t2 - t])
    return {s: reached[s] for s in J.STEPS}, {p: tuple(int(x) for x in v) for p, v in pairs.items()}


def rows_of(seed, users=50, n=900):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, *range(users)]), rng.randrange(60), rng.choice([*J.STEPS, "other"])) for _ in range(n)]
    return rows + [(None, 1, "view"), (3, None, "view"), (99, 5, "purchase"), (98, 5, "click"), (98, 5, "view")]


@pytest.mark.parametrize("batch,tasks", [("10000", "1"), ("3", "5"), ("1", "8"), ("17", "2")])
def test_like_loops(spark, batch, tasks):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, (batch, tasks)):
        spark.conf.set(k, v)
    try:
        rows = rows_of(int(batch))
        df = spark.createDataFrame(rows, "user_id long, t long, event_type string").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
        users, pairs = brute(rows)
        assert {r.step: r.users for r in J.funnel(df).collect()} == users
        got = {(r.from_step, r.to_step): r for r in J.transitions(df).collect()}
        assert {p: r.transitions for p, r in got.items()} == {p: n for p, (n, _) in pairs.items()}
        for p, (n, gap) in pairs.items():
            assert abs(got[p].mean_gap_sec - gap / n) < 1e-9
            assert abs(got[p].share - n / sum(m for (a, _), (m, _) in pairs.items() if a == p[0])) < 1e-12
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_scan_of_the_events(spark, tmp_path):
    spark.createDataFrame(rows_of(1), "user_id long, t long, event_type string").withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "e"))
    seen = []
    real = J.write_shared
    try:
        J.write_shared = lambda df, label: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1]
        out = J.funnel(spark.read.parquet(str(tmp_path / "e")))
    finally:
        J.write_shared = real
    assert len(seen) == 1 and seen[0].count("FileScan parquet") == 1
    assert str(tmp_path / "e") not in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    df = spark.createDataFrame([], "user_id long, ts timestamp, event_type string")
    assert {r.users for r in J.funnel(df).collect()} == {0} and J.transitions(df).collect() == []
