"""Disk: rows are counted by digests, and what a landing shuffled goes when it is written."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from tijara.plans import canonical as K
from tijara.operators import cleaning as CL
from tijara.plans import q_cleaning as QC
from tijara.plans import q_profile as QP
from tijara.plans.registry import load_all
from tijara.session import disk_spared


class _Canon:
    def __init__(self, **frames):
        self._frames, self._cache = frames, {}

    def get(self, name):
        return self._frames[name]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).name().startswith("shuffle_")}


def test_f3_identical_rows_are_counted_by_a_digest(spark, monkeypatch):
    rows = [("1:a", "b"), ("1:a", "b"), ("1:", "ab"), (None, "b"), (None, "b"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "`a b` string, c string")
    monkeypatch.setattr(QC.K, "canon", lambda *_: _Canon(raw_transactions=df))
    out = QC.dedupe_rows(spark, "x")
    assert tuple(out.first()) == (7, 5, 2)
    # Only the digest is moved, not the columns.
    assert "sha2" in _plan(out)
    monkeypatch.setattr(QC.K, "canon", lambda *_: _Canon(raw_transactions=df.filter("false")))
    assert tuple(QC.dedupe_rows(spark, "x").first()) == (None, 0, None)


def test_f3_shuffle_files_of_a_landing_go_with_it(spark):
    def write():
        df = spark.range(2000).repartition(3, "id").groupBy(F.col("id") % 7).count()
        df.write.parquet(os.path.join(tempfile.mkdtemp(prefix="tijara-test-"), "t"))

    def left(before):
        end = time.time() + 20
        while (more := _shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.2)
        return more
    before = _shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    with disk_spared(spark):
        with disk_spared(spark):
            pass
        assert spark.conf.get(key) == "true"
        write()
    assert not left(before) and spark.conf.get(key, None) == was
    before = _shuffle_files(spark)
    write()
    assert _shuffle_files(spark) - before


ODD = [("1:a", "b", 0.0), ("1:a", "b", -0.0), ("1:", "ab", -0.0), (None, "b", 0.0), (None, None, None), (None, None, None), ("-", "b", float("nan")), ("-", "b", float("nan"))]


def _as_text(df):
    return sorted(map(str, df.collect()))


def test_f4_rows_without_a_copy_stay(spark, monkeypatch):
    df = spark.createDataFrame(ODD, "`a b` string, c string, x double").repartition(3)
    want = _as_text(df.dropDuplicates())
    out = CL.dedupe_in_place(df)
    assert len(want) == 5 and _as_text(out) == _as_text(CL.dedupe_in_place(df, df)) == want
    assert "-0.0" not in str(want) and out.dtypes == df.dtypes
    # Only rows with a repeated hash go on to the digest.
    assert "LeftAnti" in _plan(out) and "LeftSemi" in _plan(out)
    assert CL.dedupe_in_place(df.filter("false")).collect() == []
    nested = df.withColumn("m", F.create_map("c", "x")).withColumn("s", F.array("c")).filter("c IS NOT NULL")
    assert CL.dedupe_in_place(nested).count() == 4
    monkeypatch.setattr(CL, "REPEATED_BROADCAST", 0)
    out = CL.dedupe_in_place(df, df)
    assert _as_text(out) == want and "LeftAnti" not in _plan(out)


TX = ["order_id_stage", "Code Client", "order_date", "sku", "product_name", "subcategory", "quantity", "unit_price", "line_total", "Titre moyen du paiement",
      "Titre de la méthode d’expédition", "Montant total de la commande", "Montant de l’expédition commande"]


def _transactions(spark):
    line = ("ORD1", "CLT_S00001", "2024-01-01 00:00:00", "7", " a  b ", "s", "1", "-2.00", "2.00", "Paiement mobile", "Free pickup", "1,000.00 DA", None)

    def but(**x):
        return tuple(x.get(c, v) for c, v in zip(TX, line, strict=True))
    rows = [line, line, line, but(sku="8", product_name=None), but(sku="8", product_name=None), but(sku=None, subcategory=None), but(sku="9", subcategory=None),
            but(quantity=None), but(order_date="n/a", **{"Montant total de la commande": "1000.00 DA"}), but(order_date="x", **{"Montant total de la commande": "1000.00"})]
    cat = [("8", "c\t d", "t"), ("8", "z", "t"), (None, "e", "u"), ("9", "f", None)]
    return (spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in TX)).repartition(2),
            spark.createDataFrame(cat, "`SkU` string, `Nom` string, `Sous-catégorie` string"))


def test_f4_only_rows_that_lack_something_are_moved(spark, monkeypatch):
    raw, cat = _transactions(spark)
    seen = []
    real = CL.write_shared
    monkeypatch.setattr(CL, "write_shared", lambda df, label: (seen.append(_plan(df)), real(df, label))[1])
    clean, actions = CL.clean_with_actions(raw, cat)
    got = {r.code: r.affected_rows for r in actions.collect()}
    # Both bad dates are null and 1,000.00 is 1000.00: the typed rows are equal.
    assert got == {"money_text": 10, "whitespace": 8, "payment_labels": 0, "shipping_classes": 10, "duplicates_removed": 4, "incomplete_removed": 1}
    assert clean.count() == 5 and clean.columns == CL.clean_transactions(raw, cat).columns
    assert _as_text(clean) == _as_text(CL.clean_transactions(raw, cat))
    assert {r.product_name for r in clean.collect()} == {"a b", "c d"} and clean.filter("subcategory = 'Unknown'").count() == 2
    assert len(seen) == 2 and "LeftAnti" in seen[0] and "Union" in seen[1]
    empty, actions = CL.clean_with_actions(raw.filter("false"), cat)
    assert empty.count() == 0 and not any(r.affected_rows for r in actions.collect())


def _blank(df):
    return sum(v is None or not str(v).strip() for r in df.collect() for v in r)


def test_f2_metrics_start_from_stored_typed_rows(spark, monkeypatch):
    raw, cat = _transactions(spark)
    c = _Canon(raw_transactions=raw, raw_catalogue=cat)
    monkeypatch.setattr(QP.K, "canon", lambda *_: c)
    out = QP.prep_metrics(spark, "x")
    clean = CL.clean_transactions(raw, cat)
    got = out.first().asDict()
    assert got == {"received": 10, "retained": 5, "removed": 5, "raw_missing": _blank(raw), "raw_duplicates": 3, "cleaned_missing": _blank(clean),
                   "cleaned_duplicates": 0, "rejected": 1, "retention_pct": 50.0, "removed_pct": 50.0}
    # No whole row is moved to be deduplicated, and both readers of the typed rows take the stored ones.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "first(" not in plan and plan.count("FileScan parquet") >= 3 and plan.count("Scan ExistingRDD[order_id_stage") == 1
    assert _as_text(QC.clean_tx(c)) == _as_text(clean)
    none = _Canon(raw_transactions=raw.filter("false"), raw_catalogue=cat)
    monkeypatch.setattr(QP.K, "canon", lambda *_: none)
    assert tuple(QP.prep_metrics(spark, "x").first())[:6] == (0, 0, 0, None, None, None)


SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string",
    "events": "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"}


def _tables(spark):
    day = "2024-01-{:02d} 00:00:00"
    rows = {"region": [(0, "AFRICA")], "nation": [(0, "ALGERIA", 0)], "customer": [(i, f"c{i}", 0, 1.0, "BUILDING") for i in (1, 2)],
            "part": [(i, f"red  part {i}", "Brand#1", "TIN", 3, 9.5) for i in range(1, 9)],
            "orders": [(k, 1 + k % 2, "FOP"[k % 3], 100.0 * k, day.format(1 + k % 28), "1-URGENT") for k in range(40, 101)],
            "lineitem": [(k, 1 + (k + n) % 8, 1, n, float(n), 20.5 * n, 0.0, 0.0, "NR"[n % 2], "O", day.format(5)) for k in range(40, 101) for n in (1, 2, 3)],
            "events": [(1, day.format(2), 7, "click", 1.0, '{"k": 1}')]}
    root = tempfile.mkdtemp(prefix="tijara-test-")
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows[name], schema)
        df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c in ("o_orderdate", "l_shipdate", "ts")})
        df.write.parquet(os.path.join(root, f"{name}.parquet"))
    return root


def test_f1_a_run_types_its_rows_once(spark, monkeypatch):
    root, labels, moved = _tables(spark), [], []
    prep, cov = QP.prep_metrics(spark, root).first(), QP.date_coverage(spark, root).first()
    assert prep.raw_duplicates == 6 and prep.received == 3 * 61 + 6 and prep.rejected > 0
    assert prep.retained == QC.clean_tx(QC.K.canon(spark, root)).count() == prep.received - 6 - prep.rejected
    real, dedupe = QC.write_shared, CL.dedupe_rows
    monkeypatch.setattr(QC, "write_shared", lambda df, label: (labels.append(label), real(df, label))[1])
    monkeypatch.setattr(CL, "dedupe_rows", lambda df: (moved.append(df.columns), dedupe(df))[1])
    got = load_all()["run_history"][0](spark, root).collect()
    assert len({r.run_id for r in got}) == len(got) == 2
    assert {(r.rows, r.retention_percentage, r.date_min, r.date_max) for r in got} == {(prep.retained, prep.retention_pct, cov.date_min, cov.date_max)}
    # Typed and deduplicated once for the metrics, the coverage and the checks; only rows with a repeated hash are moved for it.
    assert labels == ["typed-transactions"] and len(moved) == 1
