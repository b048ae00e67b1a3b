"""What a query moves and writes must not grow faster than its input."""

import os
import uuid

from pyspark.sql import functions as F

from tijara.operators import cleaning as CL
from tijara.operators import ingest as IN
from tijara.operators import profile as PR
from tijara.sources import files as FS


def _exports(spark):
    made = []

    def frame(name):
        def get():
            made.append(name)
            return spark.range(3).select(F.concat(F.lit(f'{name};'), "id").alias("a"), F.lit(None).cast("string").alias("b"))
        return get
    return made, {n: (frame(n), ";") for n in ("transactions", "orders")}


def test_landing_writes_only_what_is_asked_for(spark):
    made, frames = _exports(spark)
    sf = f"/nowhere/{uuid.uuid4().hex}"
    root = FS.ensure_landing(spark, sf, {"orders": frames["orders"]})
    assert made == ["orders"] and os.listdir(root) == ["orders"]
    FS.ensure_landing(spark, sf, frames)
    assert made == ["orders", "transactions"]


def test_landing_is_compressed_in_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(FS, "FILE_RECORDS", 2)
    _made, frames = _exports(spark)
    root = FS.ensure_landing(spark, f"/nowhere/{uuid.uuid4().hex}", {"orders": (lambda: frames["orders"][0]().coalesce(1), ";")})
    files = [f for f in os.listdir(os.path.join(root, "orders")) if f.startswith("part-")]
    assert all(f.endswith(".csv.gz") for f in files)
    assert len(files) == 2
    back = FS.read_raw_csv(spark, os.path.join(root, "orders"), ["a", "b"], sep=";")
    assert sorted(r["a"] for r in back.collect()) == [f'orders;{i}' for i in range(3)]


def _odd(spark):
    return spark.createDataFrame([("1", "x"), ("1", "x"), ("NaN", None), (" 0x1p3 ", "a:1"), ("-Infinity", ""), (None, None), (None, None), ("1e3f", "2020-01-01 00:00:00")],
                                 "a string, b string")


def test_column_profile_parses_values_not_cells(spark):
    df = _odd(spark)
    got = {r["name"]: tuple(r)[1:] for r in PR.column_profile(df).collect()}
    assert got == {"a": ("number", 6, 2, 5), "b": ("string", 5, 3, 4)}
    assert PR.column_profile(df.filter("false")).count() == 0
    dates = spark.createDataFrame([("2020-01-01 00:00:00",), ("+12020-01-01 00:00:00",), (None,)], "d string")
    assert PR.column_profile(dates).first()["inferred_type"] == "datetime"
    # No unpivot: a cell is not a row of its own on the way to the shuffle.
    assert "Expand" not in PR.column_profile(df)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_told_apart_by_a_digest(spark):
    rows = [("1:a", "b", 0.0), ("1:a", "b", -0.0), ("1:", "ab", 0.0), (None, "b", 0.0), ("-", "b", 0.0), ("", "b", None), ("-", "b", float("nan")), ("-", "b", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    assert PR.duplicate_rows(df).first()["duplicate_rows"] == 2
    assert CL.dedupe_rows(df).count() == df.dropDuplicates().count() == 6
    assert sorted(map(str, CL.dedupe_rows(df).collect())) == sorted(map(str, df.dropDuplicates().collect()))
    # What is not read after the dedupe is not moved.
    plan = CL.dedupe_rows(df).agg(F.count("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "first(a" not in plan and "sha2" in plan


def test_copies_only_are_moved(spark):
    df = _odd(spark).repartition(3)
    got = sorted((r["a"] or "", r["occurrence"]) for r in PR.duplicate_occurrences(df, []).collect())
    assert got == [("", 2), ("1", 2)]
    assert "_of" in PR.duplicate_occurrences(df, [])._jdf.queryExecution().optimizedPlan().toString()


def test_quality_of_a_table_in_one_pass(spark):
    assert tuple(PR.table_quality(_odd(spark)).first()) == (8, 6, 2)
    assert tuple(PR.table_quality(_odd(spark).filter("false")).first()) == (0, None, None)


def _loads(spark):
    """Stored keys 0 to 599 (some without a key); batch keys 300 to 899, each tenth twice, and 50 rows without a key."""
    stored = spark.range(0, 600).select(F.col("id").alias("k"), F.lit(0).alias("v")).unionByName(
        spark.range(3).select(F.lit(None).cast("bigint").alias("k"), F.lit(9).alias("v")))
    k = F.col("id")
    batch = spark.range(300, 900).select(k.alias("k"), (k % 2).cast("int").alias("v"), F.lit(0).alias("pos"))
    again = batch.filter("k % 10 = 0").select("k", F.lit(7).alias("v"), F.lit(1).alias("pos"))
    return stored, batch.unionByName(again).unionByName(spark.range(50).select(F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("v"), F.lit(0).alias("pos")))


def _most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_a_load_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(IN, "TASK_ROWS", 10)
    stored, batch = _loads(spark)
    acts = IN.classify_upsert(stored, batch, "k", ["v"], ["pos"])
    got = {(r["action"], r["none"]): r["count"] for r in acts.groupBy("action", F.col("k").isNull().alias("none")).count().collect()}
    assert got == {("stored_only", False): 300, ("unchanged", False): 150, ("updated", False): 150, ("inserted", False): 300,
                   ("rejected", False): 60, ("rejected", True): 50}
    # 71 tasks for 710 rows: not put together again, and rows without a key are not in one of them.
    assert _most_in_a_task(acts.filter("k IS NOT NULL")) <= 40
    # Rows without a key are not moved at all.
    assert _most_in_a_task(acts.filter("k IS NULL")) < 50
    snap = IN.apply_upsert(stored, batch, "k", ["pos"])
    rows = {tuple(r) for r in snap.collect()}
    assert rows == {(None, 9)} | {(i, 0) for i in range(300)} | {(i, i % 2) for i in range(300, 900)} and snap.count() == 903
    assert _most_in_a_task(snap.filter("k IS NOT NULL")) <= 40
    assert _most_in_a_task(IN.accepted(batch, "k", ["pos"])) <= 40


def test_profile_looks_at_a_cell_once(spark):
    from tijara.operators import sketches as SK
    cells = ["1", " -2.5e1 ", "+.5", "9", ":1", "A1", "1 kg", "", "\t4\n", "-", "NaN", "é1", None]
    df = spark.createDataFrame([(c,) for c in cells], "a string")
    r = SK.merged(SK.profile(df, F.lit("x"))).first()
    assert (r["rows"], r["missing"], r["n_numbers"], r["low"], r["high"]) == (13, 1, 5, -25.0, 9.0)
    plan = SK.profile(df, F.lit("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("try_cast") + plan.count("cast(") <= 2
