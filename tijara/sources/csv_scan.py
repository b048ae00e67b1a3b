"""Parallel scan of CSV files whose quoted cells may hold line breaks.

A reader that must see a file from its first byte to know whether a line break
is quoted makes every file one task.  Here a file is read in splits, as text:

1. Every split counts its quotes.  Their parity is all that a later split needs
   to know of an earlier one (a doubled quote inside a cell leaves it as it is).
2. A prefix sum of the parities over a file's splits, one small row each, tells
   whether a split begins inside quotes; the prefix sum of their line counts
   numbers the lines.
3. Every split is read again and cuts its lines into records where the running
   parity is even.  A record that lies in one split is emitted there.
4. What a border cuts (the end of one split, whole splits inside quotes, the
   beginning of another) is put together by an aggregation over those pieces.

Quotes work as in RFC 4180: any quote opens or closes a quoted stretch.  Records
end with a line feed, a carriage return or both; inside quotes breaks are kept.
A byte order mark at a file's beginning goes, as do empty lines.  A quote that
never closes makes the rest of its file one record; where that is longer than
``max_record`` characters, each of its lines becomes a record of its own instead
(so that no task has to hold the rest of a file).

The two reads must see the same splits, which depend on the session's settings
and on ``spark.sql.files.minPartitionNum``; that one is pinned if unset, and a
split that the first read did not have is an error.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_shared

BOM = "﻿"
MAX_RECORD = 64 << 20
SPLITS_BROADCAST = 200_000


def _lines(spark: SparkSession, path) -> DataFrame:
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))


def _split_id() -> Column:
    return F.xxhash64("file_path", "start")


def splits(spark: SparkSession, path) -> DataFrame:
    """One row for every split that holds the beginning of a line: file_path, start,
    split (its id), quoted (begins inside quotes), odd (its own parity), line (lines
    of the file before it), header (the first line that is not empty is in it)."""
    t = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    filled = ~F.col("value").isin("", "\r", BOM, BOM + "\r")
    t = t.groupBy("file_path", "start").agg((F.sum(quotes) % 2 == 1).alias("odd"), F.count("*").alias("lines"),
                                            F.bool_or(filled).alias("filled"))
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("file_path", "start", _split_id().alias("split"),
                    F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2 == 1, F.lit(False)).alias("quoted"), "odd",
                    F.coalesce(F.sum("lines").over(before), F.lit(0).cast("long")).alias("line"),
                    (F.col("filled") & ~F.coalesce(F.bool_or("filled").over(before), F.lit(False))).alias("header"))


class _Split:
    """Lines of one split, batch by batch, to records and border pieces."""

    def __init__(self, key, start: int, quoted: bool, line: int, header: bool):
        self.key, self.inside, self.line = key, quoted, line
        self.bom, self.header = start == 0, header
        self.head = quoted  # what comes first belongs to a record begun before
        self.held: list[str] = []  # lines of a record that is not complete, with their breaks
        self.held_line = line

    def take(self, values):
        """(records, their first lines, head piece or None) of some more lines."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if self.bom and len(values):
            first = values[0].as_py()
            self.bom = False
            if first.startswith(BOM):
                values = pa.concat_arrays([pa.array([first[1:]], pa.string()), values.slice(1)])
        body = pc.utf8_rtrim(values, characters="\r")
        if pc.any(pc.match_substring(body, "\r")).as_py():
            return self._slow(values)
        odd = np.bitwise_and(pc.count_substring(values, '"').to_numpy(zero_copy_only=False), 1)
        inside = (np.cumsum(odd) + self.inside) % 2  # after each line
        ends = np.flatnonzero(inside == 0)
        lines = self.line + np.arange(len(values))
        self.line += len(values)
        out, at, head = [], [], None
        done = 0
        if len(ends) and (self.held or self.head):
            e = int(ends[0])
            text = "".join(self.held) + "\n".join(values.slice(0, e + 1).to_pylist())
            if self.head:
                head = text
            else:
                out.append(text)
                at.append(self.held_line)
            self.held, self.head, done = [], False, e + 1
            ends = ends[1:]
        if len(ends):
            stop = int(ends[-1]) + 1
            begin = np.append(done, ends[:-1] + 1)
            part = values.slice(done, stop - done)
            if stop - done > len(ends):
                offs = pa.array(np.append(begin, stop) - done, pa.int32())
                part = pc.binary_join(pa.ListArray.from_arrays(offs, part), "\n")
            out.extend(part.to_pylist())
            at.extend(lines[begin].tolist())
            done = stop
        if done < len(values):
            if not self.held:
                self.held_line = int(lines[done])
            self.held.extend(v + "\n" for v in values.slice(done).to_pylist())
        self.inside = bool(inside[-1]) if len(inside) else self.inside
        return self._tidy(out, at, head)

    def _slow(self, values):
        """The same where carriage returns end records inside a line."""
        out, at, head = [], [], None
        for value in values.to_pylist():
            units = re.findall(r"[^\r]*\r(?!$)|[^\r]+\r?$|\r$", value) or [""]
            for k, unit in enumerate(units):
                last = k == len(units) - 1
                if not self.held:
                    self.held_line = self.line
                self.held.append(unit + "\n" if last else unit)
                self.inside ^= unit.count('"') % 2 == 1
                if not self.inside:
                    text = "".join(self.held)
                    text = text[:-1]  # its break; a return before a line feed goes in _tidy
                    if self.head:
                        head = text
                    else:
                        out.append(text)
                        at.append(self.held_line)
                    self.held, self.head = [], False
            self.line += 1
        return self._tidy(out, at, head)

    def _tidy(self, out, at, head):
        out = [r[:-1] if r.endswith("\r") else r for r in out]
        keep = [k for k, r in enumerate(out) if r]
        if len(keep) < len(out):
            out, at = [out[k] for k in keep], [at[k] for k in keep]
        if self.header and out:
            self.header, out, at = False, out[1:], at[1:]
        return out, at, head

    def rest(self):
        """(piece, line, is the header) left at the end, or None."""
        if not self.held:
            return None
        return "".join(self.held), self.held_line, self.header


_RECORD = "split long, line long, record string"
_PIECE = "split long, line long, tail boolean, header boolean, piece string"


def _scan(pieces: bool):
    def run(batches):
        """Lines with their split's facts -> whole records, or border pieces."""
        import pyarrow as pa
        now: _Split | None = None

        def closing():
            left = now.rest() if now is not None else None
            if pieces and left is not None:
                # A split that never leaves the quotes it began in is one piece of another's record.
                yield pa.RecordBatch.from_pydict({"split": [now.key], "line": [left[1]], "tail": [not now.head], "header": [left[2]],
                                                  "piece": [left[0]]}, schema=schema)

        schema = pa.schema([("split", pa.int64()), ("line", pa.int64())] + (
            [("tail", pa.bool_()), ("header", pa.bool_()), ("piece", pa.string())] if pieces else [("record", pa.string())]))
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            borders = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)])) if len(ids) else []
            for i, j in zip(borders[:-1], borders[1:]):
                i, j = int(i), int(j)
                if now is None or now.key != int(ids[i]):
                    yield from closing()
                    start, quoted, line, header = (b.column(2 + k)[i].as_py() for k in range(4))
                    if quoted is None:
                        raise ValueError("the file was split in another way than on the first read; set spark.sql.files.minPartitionNum")
                    now = _Split(int(ids[i]), start, quoted, line, header)
                values = b.column(0).slice(i, j - i)
                out, at, head = now.take(values)
                if pieces:
                    if head is not None:
                        yield pa.RecordBatch.from_pydict({"split": [now.key], "line": [-1], "tail": [False], "header": [False],
                                                          "piece": [head]}, schema=schema)
                elif out:
                    yield pa.RecordBatch.from_pydict({"split": [now.key] * len(out), "line": at, "record": out}, schema=schema)
        yield from closing()
    return run


def _placed(lines: DataFrame, facts: DataFrame, how: str, small: bool) -> DataFrame:
    """Lines with the facts of their split, in the order of the file."""
    f = facts.select(F.col("split").alias("of"), "start", "quoted", "line", "header")
    t = lines.select("value", _split_id().alias("split"))
    cols = ["value", "split", "start", "quoted", "line", "header"]
    if small:
        return t.join(F.broadcast(f), F.col("split") == F.col("of"), how).select(*cols)
    t = t.withColumn("pos", F.monotonically_increasing_id()).join(f, F.col("split") == F.col("of"), how)
    return t.sortWithinPartitions("split", "pos").select(*cols)


def csv_records(spark: SparkSession, path, header: bool = True, max_record: int = MAX_RECORD) -> DataFrame:
    """split, line, record: the records of all files below ``path``, without each
    file's first one if ``header``; ``line`` is the number (from 0) of the line of
    its file at which a record begins.  Empty lines are no records."""
    facts = write_shared(splits(spark, path), "csv-splits")
    n, cut = facts.agg(F.count("*"), F.count_if(F.col("quoted") | F.col("odd"))).first()
    if not header:
        facts = facts.withColumn("header", F.lit(False))
    small = n <= SPLITS_BROADCAST
    whole = _placed(_lines(spark, path), facts, "left", small).mapInArrow(_scan(False), _RECORD)
    if not cut:
        return whole
    border = facts.filter("quoted or odd")
    p = _placed(_lines(spark, path), border, "inner", small).mapInArrow(_scan(True), _PIECE)
    p = p.join(facts.select(F.col("split").alias("of"), "file_path", "start"), F.col("split") == F.col("of"))
    # A split's head belongs to the record before its own tail.
    order = ["start", "tail"]
    p = write_shared(p.select("file_path", "start", "split", "line", "tail", "header", "piece"), "csv-pieces")
    slim = p.select("file_path", "start", "tail", F.length("piece").cast("long").alias("n"))
    mine = Window.partitionBy("file_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    slim = slim.withColumn("rec", F.sum(F.col("tail").cast("int")).over(mine))
    size = slim.groupBy("file_path", "rec").agg(F.sum("n").alias("size"))
    slim = slim.join(size, ["file_path", "rec"]).select(F.col("file_path").alias("f"), F.col("start").alias("s"), F.col("tail").alias("t"), "rec", "size")
    p = p.join(slim, (F.col("file_path") == F.col("f")) & (F.col("start") == F.col("s")) & (F.col("tail") == F.col("t")))
    joined = (p.filter(F.col("size") <= max_record).groupBy("file_path", "rec")
              .agg(F.sort_array(F.collect_list(F.struct(*order, "piece", "split", "line", "header"))).alias("p"))
              .select(F.col("p")[0]["split"].alias("split"), F.col("p")[0]["line"].alias("line"), F.col("p")[0]["header"].alias("first"),
                      F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("record")))
    # The break that ends a record stayed outside its last piece, or stands at the end of the file.
    joined = joined.select("split", "line", F.regexp_replace("record", r"(\r\n|\n|\r)\z", "").alias("record"), "first")
    loose = (p.filter(F.col("size") > max_record).select("split", "line", "header", F.posexplode(F.split("piece", "\n")).alias("k", "record"))
             .select("split", F.when(F.col("line") >= 0, F.col("line") + F.col("k")).otherwise(-1).alias("line"),
                     F.regexp_replace("record", r"\r\z", "").alias("record"), (F.col("header") & (F.col("k") == 0)).alias("first")))
    late = joined.unionByName(loose).filter("record <> '' and not first").drop("first")
    return whole.unionByName(late)
