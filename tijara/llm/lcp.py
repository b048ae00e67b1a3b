"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  On a level, runs of one symbol become one
symbol; deterministic coin tossing (lowest bit in which a symbol differs from
its left neighbour, four times) turns the names into six colours, neighbours
never sharing one; phrases begin at inner local maxima; a phrase's name is a
hash of its symbols.  Whether a phrase begins at a place depends on a few
symbols around it only, so equal substrings get equal names inside whatever
stands before or after them and wherever they begin.

The signature set of a text holds its phrase names from level ``MIN_LEVEL`` on
(phrases of some 25 code points and up) and the name of the whole.  The
fingerprint keeps, in ``SLOTS`` slots, one byte of the least name that falls in
the slot (0: none does).  The likeness of two fingerprints is the share of
slots in use that agree, an estimate of the overlap of the signature sets.

Cases: a null text counts as empty and has an empty fingerprint, which is like
another empty one (1.0) and unlike any other (0.0); equal texts have equal
fingerprints; whole texts are parsed whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import take, write_shared

SLOTS = 128
MIN_LEVEL = 3
CHUNK = 1 << 20  # code points parsed at a time
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit differing from the left neighbour) + that bit.
    The first symbol of a text is set against its complement."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    x = label ^ left
    low = x & (~x + np.ones(1, x.dtype))
    place = np.bitwise_count(low - np.ones(1, x.dtype))
    return place * np.uint8(2) + ((label & low) != 0).astype(np.uint8)


def colours(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Colours 0 to 5, different from the left neighbour's within a text."""
    c = _toss(names, first)
    for _ in range(3):
        c = _toss(c, first)
    return c


def parse(points: np.ndarray, offs: np.ndarray, min_level: int = MIN_LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of all signatures of the texts laid out in ``points`` at ``offs``."""
    text, names, level = np.flatnonzero(np.diff(offs) > 0), points.astype(np.uint64), 0
    start = offs[:-1][text]
    out_text, out_name = [], []
    while len(names):
        owner_start = start
        n = len(names)
        first = np.zeros(n, bool)
        first[owner_start] = True
        # Runs of one symbol.
        head = first.copy()
        head[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(head)
        run = np.diff(np.append(at, n))
        names = names[at]
        many = run > 1
        if many.any():
            names[many] = _mixed(names[many] * _A + run[many].astype(np.uint64))
        first = first[at]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(names)))
        # Texts of one symbol are done: it names them whole.
        done = size == 1
        if done.any():
            out_text.append(text[done])
            out_name.append(_mixed(names[start[done]] + np.uint64(level)))
            keep = np.repeat(~done, size)
            names, first, text, size = names[keep], first[keep], text[~done], size[~done]
            start = np.flatnonzero(first)
        if not len(names):
            break
        level += 1
        c = colours(names, start)
        # Inner local maxima begin phrases, and so does each text.
        begin = first.copy()
        peak = np.zeros(len(names), bool)
        peak[1:-1] = (c[1:-1] > c[:-2]) & (c[1:-1] > c[2:])
        peak[start] = False
        peak[np.append(start[1:], len(names)) - 1] = False
        begin |= peak
        at = np.flatnonzero(begin)
        length = np.diff(np.append(at, len(names)))
        place = (np.arange(len(names)) - np.repeat(at, length)).astype(np.uint64)
        names = _mixed(np.add.reduceat(_mixed(names + place * _A + np.uint64(level)), at) + length.astype(np.uint64))
        start = np.searchsorted(at, start)
        if level >= min_level:
            count = np.diff(np.append(start, len(names)))
            out_text.append(np.repeat(text, count))
            out_name.append(_mixed(names ^ _mixed(np.full(1, level, np.uint64))))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_text), np.concatenate(out_name)


def sketch(texts: list[str], min_level: int = MIN_LEVEL) -> np.ndarray:
    """One row of ``SLOTS`` bytes for each text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
            n += len(texts[j])
            j += 1
        part = texts[i:j]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in part])))
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        text, name = parse(points, offs, min_level)
        least = np.full((j - i) * SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
        slot = text * SLOTS + (name >> np.uint64(57)).astype(np.int64)
        value = name & np.uint64((1 << 57) - 1)
        np.minimum.at(least, slot, value)
        used = least != np.uint64(0xFFFFFFFFFFFFFFFF)
        got = np.zeros(len(least), np.uint8)
        got[used] = (least[used] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        out[i:j] = got.reshape(-1, SLOTS)
        i = j
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) of every text, without any shuffle."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([r.tobytes().hex() for r in sketch(texts)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    src = take(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its
    code points (rounded down) replaced by the first as many of the next
    document's, in the order of (doc_id, hash of the text), null ids last.

    Documents are dealt once, by ranges of doc_id, into as many ranges as there
    are shuffle partitions; the first document of each range is also sent to
    the end of the one before.  That table has one row for each range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("text"))
    cuts = src.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5],
                                       max(10_000, 20 * parts))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids):
        known = ids.notna().to_numpy()
        at = np.full(len(ids), len(cuts), np.int32)
        at[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="right")
        return type(ids)(at)

    src = src.withColumn("part", range_of("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    heads = src.drop("text").groupBy("part").agg(F.min(order).alias("o"))
    # One row for each range: the order of ranges, and whose end each head goes to.
    every = Window.orderBy("part")
    heads = heads.select("o", F.coalesce(F.lag("part").over(every), F.max("part").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    heads = write_shared(heads, "range-heads").select("to", F.col("o.doc_id").alias("head_id"), F.col("o.tie").alias("head_tie"))
    tails = (src.select("doc_id", "text", "tie")
             .join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("tie").eqNullSafe(F.col("head_tie")))
             .dropDuplicates(["to"]).select("doc_id", "text", "tie", F.col("to").alias("part"), F.lit(1).alias("tail")))
    rows = src.withColumn("tail", F.lit(0)).unionByName(tails)
    rows = rows.repartitionById(len(cuts) + 1, F.col("part"))
    rows = rows.sortWithinPartitions("tail", F.col("doc_id").asc_nulls_last(), "tie").select("doc_id", "text", "tail")

    def run(batches):
        import pyarrow as pa
        held = None  # last row so far: id, text, tail, sketch
        for b in batches:
            got = list(zip(b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()))
            for k in range(0, len(got), 250):
                now = got[k:k + 250]
                marks = sketch([t for _, t, _ in now])
                seq = ([held] if held else []) + [(*r, m) for r, m in zip(now, marks)]
                held = seq[-1]
                pairs = [(x, y) for x, y in zip(seq, seq[1:]) if not x[2]]
                if not pairs:
                    continue
                edited = [x[1][:len(x[1]) - len(x[1]) // 2] + y[1][:len(x[1]) // 2] for x, y in pairs]
                own, following = np.array([x[3] for x, _ in pairs]), np.array([y[3] for _, y in pairs])
                other = sketch(edited)
                cols = [pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                        pa.array([r.tobytes().hex() for r in own]), pa.array([r.tobytes().hex() for r in other]),
                        pa.array(likeness(own, other)), pa.array(likeness(own, following))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                                        "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
