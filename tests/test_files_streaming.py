"""File landing, detection and streaming jobs on small fixtures (tmp folders are fine in tests)."""
import os
import tempfile

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tijara.sources import files as FS

Q = E.queries()


def test_csv_detection_bom_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="tijara-test-")
    os.makedirs(os.path.join(d, "a"))
    with open(os.path.join(d, "a", "x.csv"), "w", encoding="utf-8") as fh:
        fh.write("﻿SKU;Nom;Catégorie\n\n1;\"a;b\";x\n1;\"a;b\";x\n2;;y\n3;z\n")
    lines = FS.text_lines(spark, os.path.join(d, "a"))
    h = FS.file_headers(lines).first()
    assert h.delimiter == ";" and h.canonical == ["sku", "product_name", "category"] and h.dataset == "catalogue"
    q = FS.dataset_quality(lines).first()
    assert (q.rows, q.duplicate_rows, q.malformed_rows) == (4, 1, 1)
    assert q.missing_values == 2  # the blank name and the missing third cell
    df = FS.read_raw_csv(spark, os.path.join(d, "a"), ["SKU", "Nom", "Catégorie"], sep=";")
    assert df.filter(F.col("SKU").isNotNull()).count() == 4


def _file(d, name, text):
    os.makedirs(os.path.join(d, name))
    with open(os.path.join(d, name, "x.csv"), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_csv_quality_counts_records(spark):
    """Line breaks and delimiters in quotes are content; only the first line has a BOM."""
    d = tempfile.mkdtemp(prefix="tijara-test-")
    _file(d, "a", '\ufeffSKU,"Nom, long",Prix unitaire\n1,"two\nlines",5\n\n2,\ufeffx,6\n"2",\ufeffx,"6"\n')
    _file(d, "b", 'SKU,Nom,Prix unitaire\n1,"open,5\n2,y,6\n')
    lines = FS.text_lines(spark, [os.path.join(d, "a"), os.path.join(d, "b")])
    h = {r.file_path.split("/")[-2]: r.headers for r in FS.file_headers(lines).collect()}
    assert h["a"] == ["SKU", "Nom, long", "Prix unitaire"]
    q = {r.folder: r for r in FS.dataset_quality(lines).collect()}
    assert (q["a"].rows, q["a"].column_count, q["a"].malformed_rows, q["a"].duplicate_rows, q["a"].missing_values, q["a"].unclosed_quotes) == (3, 3, 0, 1, 0, 0)
    assert q["b"].unclosed_quotes == 1


def test_batch_rules(spark):
    d = tempfile.mkdtemp(prefix="tijara-test-")
    good = "SKU;Nom;Catégorie\n1;a;b\n"
    _file(d, "one", good)
    _file(d, "two", good)
    _file(d, "odd", "x;y\n1;2\n")
    _file(d, "bad", "SKU;Nom;Catégorie\n1;a\n")

    def verdict(*names):
        lines = FS.text_lines(spark, [os.path.join(d, n) for n in names])
        h = FS.file_headers(lines).select("file_path", "dataset")
        return FS.validate_batch(h, FS.dataset_quality(lines)).first().error
    assert verdict("one") is None and verdict("one", "two") == "duplicate_dataset"
    assert verdict("one", "odd") == "unidentified_file" and verdict("bad") == "malformed_file"


def test_web_export_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tijara-test-")
    rep = spark.createDataFrame([("Organic, Search", 10, 55.5)], "channel string, sessions long, rate double")
    FS.write_web_export(rep, os.path.join(d, "w"), "t")
    back = FS.read_web_export(spark, os.path.join(d, "w"), rep.columns).first()
    assert back.channel == "Organic, Search" and back.sessions == "10" and float(back.rate) == 55.5


def test_landing_queries(spark, duck):
    for name in ["csv_quality", "csv_roundtrip", "stream_daily_revenue", "stream_ingest_orders"]:
        s = {tuple(r) for r in Q[name](spark, SF_SMALL).collect()}
        cur = duck.execute(E.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        df_cols = Q[name](spark, SF_SMALL).columns
        d = {tuple(r[cols.index(c)] for c in df_cols) for r in cur.fetchall()}
        assert s == d, name


def _loaded(spark, land, d, files, ck="ck"):
    from pyspark.sql import functions as F

    from tijara.streaming import jobs as SJ
    snap, log = os.path.join(d, "snap"), os.path.join(d, "log")
    SJ.ingest_stream(spark, land, snap, log, os.path.join(d, ck), files_per_batch=files)
    acts = spark.read.parquet(log)
    return (sorted(tuple(map(str, r)) for r in SJ.snapshot(spark, snap).collect()),
            sorted(tuple(r) for r in acts.groupBy("action").agg(F.sum("records")).collect()),
            acts.select("batch").distinct().count())


def _orders_landing(spark):
    from tijara.plans import canonical as K
    d = tempfile.mkdtemp(prefix="tijara-test-")
    land = os.path.join(d, "landing")
    FS.write_csv(K.canon(spark, SF_SMALL).get("raw_orders").repartition(5), land)
    return d, land


def test_ingest_stream_does_not_depend_on_files_per_batch(spark):
    d, land = _orders_landing(spark)
    one, many = _loaded(spark, land, os.path.join(d, "a"), 1), _loaded(spark, land, os.path.join(d, "b"), 64)
    assert one[:2] == many[:2] and one[2] == 5 and many[2] == 1
    assert dict(one[1])["inserted"] == len(one[0]) and dict(one[1])["rejected"] > 0


def test_ingest_stream_restart_is_idempotent(spark):
    """A second availableNow run on the same checkpoint finds no new files:
    the snapshot and the action log are unchanged (exactly-once)."""
    d, land = _orders_landing(spark)
    first = _loaded(spark, land, d, 1)
    assert _loaded(spark, land, d, 1) == first


def test_ingest_batch_replay_is_deterministic(spark):
    """Replaying a batch id (as after a failure before the offset commit)
    rebuilds the same folders and the same action log."""
    d, land = _orders_landing(spark)
    first = _loaded(spark, land, d, 1)
    # a fresh checkpoint replays every batch id against the same folders
    assert _loaded(spark, land, d, 1, "ck2") == first


def test_ingest_stream_refuses_a_missing_batch(spark):
    import shutil

    from pyspark.errors import StreamingQueryException
    d, land = _orders_landing(spark)
    _loaded(spark, land, d, 4)
    os.rename(os.path.join(d, "snap", "batch=1"), os.path.join(d, "gone"))
    shutil.copy(os.path.join(land, [f for f in os.listdir(land) if f.endswith(".csv")][0]), os.path.join(land, "more.csv"))
    with pytest.raises(StreamingQueryException):
        _loaded(spark, land, d, 4)


def test_ingest_batch_does_not_read_earlier_batches(spark):
    """What earlier batches stored comes from keyed state: their folders may be
    empty, and a file that repeats every key is still rejected as a whole."""
    import shutil
    d, land = _orders_landing(spark)
    first = _loaded(spark, land, d, 1)
    for i in range(5):
        os.rename(os.path.join(d, "snap", f"batch={i}"), os.path.join(d, f"away-{i}"))
        os.makedirs(os.path.join(d, "snap", f"batch={i}"))
    copy = [f for f in os.listdir(land) if f.endswith(".csv")][0]
    n = spark.read.option("header", True).csv(os.path.join(land, copy)).count()
    shutil.copy(os.path.join(land, copy), os.path.join(land, "more.csv"))
    from tijara.streaming import jobs as SJ
    SJ.ingest_stream(spark, land, os.path.join(d, "snap"), os.path.join(d, "log"), os.path.join(d, "ck"), files_per_batch=1)
    acts = {r[0]: r[1] for r in spark.read.parquet(os.path.join(d, "log")).groupBy("action").agg(F.sum("records")).collect()}
    assert acts == {"inserted": dict(first[1])["inserted"], "rejected": dict(first[1])["rejected"] + n}
