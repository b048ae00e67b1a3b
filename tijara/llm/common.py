"""Helpers shared by the training-data operators.

Texts reach Python as Arrow string columns.  :func:`text_chunks` hands them on
as NumPy byte buffers of bounded size, so vectorised work needs memory for a
few megabytes of text at a time however many rows an Arrow batch has (one
document is never split).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import JOB_CONF, ensure_checkpoint_dir, ship_package, table_path, write_shared

__all__ = ["prepare", "read", "take", "positional", "restore", "write_shared", "text_chunks", "n_parts", "WORD", "SPACE"]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings of these jobs: shared folder, shipped package, and Arrow
    batches of ``ARROW_ROWS`` rows (documents are long)."""
    for k, v in JOB_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns renamed ``_c0, _c1, ...``: names of the input can then
    never clash with working columns.  :func:`restore` undoes it."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def restore(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def at(names: list[str], name: str) -> Column:
    """The positional column that carries the exactly named input column."""
    return F.col(f"_c{names.index(name)}")


def take(df: DataFrame, *names: str) -> DataFrame:
    """Only the exactly named columns, whatever other columns there are."""
    p, cols = positional(df)
    return p.select(*[at(cols, n).alias(n) for n in names])


def n_parts(rows: int, per_task: int) -> int:
    return max(1, math.ceil(rows / per_task))


def text_chunks(texts, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Arrow string array -> (first row, end row, bytes, row offsets into them).

    Nulls count as empty.  Every chunk holds whole documents and at most
    ``limit`` bytes unless one document alone is longer.
    """
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, buf[off[i]:off[j]], (off[i:j + 1] - off[i]).astype(np.int64)
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (``WORD``) and the row each belongs to."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = np.zeros(n + 1, bool)  # a row begins here
    first[offs] = True
    start = word & np.concatenate(([True], ~word[:-1] | first[1:n]))
    end = word & np.concatenate((~word[1:] | first[1:n], [True]))
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def keep_decided(docs: DataFrame, decided: DataFrame, key) -> DataFrame:
    """``docs`` without the rows decided against, all columns kept.

    ``decided``: doc_id, key, kept for the rows of groups larger than one, with
    exactly one kept row a group; ``key(text)`` makes the key of a document.
    Only dropped (id, key) pairs meet the documents; pairs of a kept row that
    occur on several rows (repeated rows) are reduced apart.
    """
    pairs = decided.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = pairs.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    many = pairs.filter("kept and n > 1").select(F.col("doc_id").alias("many_id"), F.col("key").alias("many_key"))
    p, names = positional(docs)
    p = p.withColumn("key", key(at(names, "text")))
    ident = at(names, "doc_id")
    # One plan at every size: texts are shuffled by key but never sorted.
    left = p.join(gone.hint("shuffle_hash"), ident.eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not many.isEmpty():
        on = ident.eqNullSafe(F.col("many_id")) & (F.col("key") == F.col("many_key"))
        once = left.join(many, on, "left_semi").dropDuplicates([f"_c{names.index('doc_id')}", "key"])
        left = left.join(many, on, "left_anti").unionByName(once)
    return restore(left, names)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _STRIDE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64; the longest so far is kept."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from running sums over the bytes."""
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_STEP, len(buf)))))
    back = powers(inverse(_STEP), len(buf) + 1)
    return mixed64((run[end] - run[start]) * back[start] + (end - start).astype(np.uint64))


class Stretches:
    """Hash of any stretch of words (first, count) in constant time."""

    def __init__(self, words: np.ndarray):
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(_STRIDE, len(words)))))
        self.back = powers(inverse(_STRIDE), len(words) + 1)

    def of(self, first: np.ndarray, count) -> np.ndarray:
        return mixed64((self.run[first + count] - self.run[first]) * self.back[first] + np.uint64(1))
