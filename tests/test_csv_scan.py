"""Parallel CSV scan against the whole-file reader, over many splits."""
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tijara.sources import csv_scan as CS
from tijara.sources import files as FS

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def split_bytes(spark):
    old = {k: spark.conf.get(k, None) for k in KEYS}

    def put(n):
        spark.conf.set(KEYS[0], str(n))
        spark.conf.unset(KEYS[1])
    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(text, name="x.csv", d=None):
    d = d or tempfile.mkdtemp(prefix="tijara-test-")
    with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return d


def _rows(seed, n, brk):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cell = rng.choice(["plain", "a;b", 'say "hi"', f"two{brk}lines", f'"{brk}{brk}"', "", "é漢", f"x{brk}" * rng.randrange(1, 30),
                           "long " * rng.randrange(1, 40)])
        quoted = '"' + cell.replace('"', '""') + '"' if re.search(r'[;"\r\n]', cell) or rng.random() < 0.2 else cell
        out.append((f"{i};{quoted};{i * 7}", (str(i), cell, str(i * 7))))
    return out


@pytest.mark.parametrize("brk", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [80, 1500, 1 << 27])
def test_like_the_rows_that_were_written(spark, split_bytes, brk, size):
    split_bytes(size)
    rows = _rows(4, 100, brk)
    d = _write("id;name;n" + brk + brk.join(r for r, _ in rows) + brk)
    _write("﻿id;name;n" + brk + '900;"é' + brk + 'x";1', "y.csv", d)
    rec = CS.csv_records(spark, d)
    want = [r for r, _ in rows] + ['900;"é' + brk + 'x";1']
    assert sorted(r.record for r in rec.collect()) == sorted(want)
    cells = [c for _, c in rows] + [("900", "é" + brk + "x", "1")]
    got = FS.read_raw_csv(spark, d, ["id", "name", "n"], sep=";", null_tokens=())
    assert sorted((r.id, r.name or "", r.n) for r in got.collect()) == sorted(cells)
    assert got.filter(F.col("_corrupt_record").isNotNull()).count() == 0
    if size == 80:
        parts = {r.p for r in rec.select(F.spark_partition_id().alias("p")).distinct().collect()}
        assert len(parts) > 8  # one file, many tasks


@pytest.mark.parametrize("size", [150, 1 << 27])
def test_like_the_whole_file_reader(spark, split_bytes, size):
    split_bytes(size)
    rows = [r for r, _ in _rows(9, 120, "\n")] + ["1;2", "1;2;3;4", "", "  ;x;y", '5;"";6']
    d = _write("id;name;n\n" + "\n".join(rows) + "\n")
    cols = ["id", "name", "n", "_corrupt_record"]
    schema = ", ".join(f"{c} string" for c in cols)
    want = (spark.read.schema(schema).option("header", True).option("sep", ";").option("escape", '"').option("multiLine", True)
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(d).select("id", "name", "n"))
    got = FS.read_raw_csv(spark, d, cols[:3], sep=";", null_tokens=()).select("id", "name", "n")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want)


def test_line_numbers(spark, split_bytes):
    split_bytes(25)
    d = _write('h;i\n1;"a\nb"\n\n2;c\n3;"\n\n\n"\n4;d\n')
    got = sorted((r.line, r.record) for r in CS.csv_records(spark, d).collect())
    assert got == [(1, '1;"a\nb"'), (4, "2;c"), (5, '3;"\n\n\n"'), (9, "4;d")]


@pytest.mark.parametrize("size", [20, 1 << 27])
def test_carriage_returns_alone_end_records(spark, split_bytes, size):
    split_bytes(size)
    d = _write('h;i\r1;"a\rb"\r2;c\r\n3;d\r\r4;"x\n"\r')
    assert sorted(r.record for r in CS.csv_records(spark, d).collect()) == ['1;"a\rb"', "2;c", "3;d", '4;"x\n"']


def test_header_is_the_first_filled_record(spark, split_bytes):
    split_bytes(15)
    d = _write("\n" * 50 + '"long\nheader over\nsplits";i\n1;a\n2;b\n')
    assert sorted(r.record for r in CS.csv_records(spark, d).collect()) == ["1;a", "2;b"]
    assert len(CS.csv_records(spark, d, header=False).collect()) == 3


def test_quote_that_never_closes(spark, split_bytes):
    split_bytes(30)
    text = 'h;i\n1;a\n2;"open\n' + "".join(f"{i};row\n" for i in range(3, 40))
    d = _write(text)
    got = sorted(r.record for r in CS.csv_records(spark, d).collect())
    assert got == ["1;a", text[text.index('2;"open'):-1]]
    loose = sorted(r.record for r in CS.csv_records(spark, d, max_record=50).collect())
    assert loose == sorted(["1;a", '2;"open'] + [f"{i};row" for i in range(3, 40)])


def test_splits_beyond_the_broadcast_bound(spark, split_bytes, monkeypatch):
    split_bytes(40)
    rows = _rows(6, 60, "\n")
    d = _write("id;name;n\n" + "\n".join(r for r, _ in rows) + "\n")
    monkeypatch.setattr(CS, "SPLITS_BROADCAST", 0)
    assert sorted(r.record for r in CS.csv_records(spark, d).collect()) == sorted(r for r, _ in rows)


def test_empty_files(spark):
    d = _write("")
    _write("h;i\n", "only-header.csv", d)
    assert CS.csv_records(spark, d).collect() == []
