"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: words of the whole text (A-Z lowered), shingles of ``n`` words
joined by one space, XXH64 with seed 42 of each, repeats included; a bit is 1
if more than half of the hashes have it.  Texts without words get zero.

Links (at most ``d`` differing bits) are found between distinct fingerprints.
Two of them agree on at least one of ``d + 1`` bit blocks, so each is sent to
``d + 1`` groups, one per block value.  A group of more than ``HOT`` members is
dealt once more in the same way by the bits left.  Inside a group fingerprints
are sorted by Gray rank and every ``FAN`` neighbours form a node, level by
level; a node keeps the bits that all below it share (mask and pattern).  A
search walks pairs of nodes from the top and adds up differences on bits that
become known: above ``d`` the pair is pruned with all below it, and if the
bits still unknown cannot raise it above ``d`` all below it are linked as a
whole.  Nodes whose members are in one component already are not walked again,
so a dense group costs no more than its links need.  The group hands on one
edge from each member to its component's first member, never all pairs.

Components of the edges come from :mod:`graph`; rows of equal fingerprints are
never compared at all.

Cases: null and empty texts have fingerprint zero and link like any other; a
null id never names a component unless all its rows lack one; repeated rows
are in one component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_decided, take, text_chunks, word_bounds, write_shared
from .graph import components

SHINGLE = 3
MAX_BITS = 3
HOT = 50_000
FAN = 4
SEED = 42
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint_chunk(buf: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the documents laid out in ``buf`` at ``offs``."""
    import xxhash

    docs = len(offs) - 1
    start, end, row = word_bounds(buf, offs)
    out = np.zeros(docs, np.uint64)
    if not len(start):
        return out
    # The words once more, each followed by one space.
    length = end - start
    at = np.cumsum(length + 1) - (length + 1)
    flat = np.full(int(at[-1] + length[-1] + 1), 32, np.uint8)
    total = int(length.sum())
    src = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
    flat[src + np.repeat(at - start, length)] = _LOWER[buf[src]]
    # A shingle runs from word i to word i + n - 1, or to the last word of a short document.
    words = np.bincount(row, minlength=docs)
    first = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    which = np.repeat(np.arange(docs), count)
    i = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
    j = np.minimum(i + n, first[which] + words[which]) - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(at[i].tolist(), (at[j] + length[j]).tolist())], np.uint64)
    has = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[has]
    step = 1 << 16  # bits of that many hashes at a time
    ones = np.zeros((docs, 64), np.int64)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a:a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = which[a:a + step]
        cut = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        ones[w[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    del starts
    out[has] = np.packbits(ones[has] * 2 > count[has][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text), fp (the 64 bits as a long)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = [fingerprint_chunk(buf, offs, n) for _, _, buf, offs in text_chunks(b.column(1), 2 << 20)]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    src = take(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("key"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, key long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in Gray order, as a long that sorts unsigned."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def grouped(distinct: DataFrame, d: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """fp -> (gid, fp, rank): every two fingerprints within ``d`` bits share a gid."""
    blocks = _blocks(list(range(64)), d + 1)
    keys = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), _masked(F.col("fp"), b).alias("value")) for i, b in enumerate(blocks)])).alias("k"))
    keys = keys.select("fp", "k.block", "k.value")
    # At most (d + 1) * 2^16 block values exist (d = 3), so this table is bounded.
    large = write_shared(keys.groupBy("block", "value").count().filter(F.col("count") > hot).drop("count"), "hot-blocks")
    cold = keys.join(large, ["block", "value"], "left_anti").select(F.xxhash64("block", "value").alias("gid"), "fp")
    if large.isEmpty():
        return cold.withColumn("rank", gray_rank(F.col("fp")))
    again = None
    for i in range(len(blocks)):
        rest = [b for b in range(64) if b not in blocks[i]]
        subs = [F.struct(F.lit(j).alias("sub"), _masked(F.col("fp"), s).alias("sub_value"))
                for j, s in enumerate(_blocks(rest, d + 1))]
        arm = F.array(*subs)
        again = arm if again is None else F.when(F.col("block") == i, arm).otherwise(again)
    warm = (keys.join(large, ["block", "value"], "left_semi").withColumn("s", F.explode(again))
            .select(F.xxhash64("block", "value", "s.sub", "s.sub_value").alias("gid"), "fp"))
    return cold.unionByName(warm).withColumn("rank", gray_rank(F.col("fp")))


class _Index:
    """Hierarchy over groups of fingerprints, each sorted by Gray rank."""

    def __init__(self, gid: np.ndarray, fp: np.ndarray, d: int):
        self.fp, self.d, n = fp, d, len(fp)
        self.label = np.arange(n)
        new = np.concatenate(([True], gid[1:] != gid[:-1]))
        begin = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        deepest = int(place.max()) if n else 0
        # Levels of nodes: leaf range, children in the level below, shared bits.
        self.first = [np.arange(n)]
        self.child: list[np.ndarray] = [np.arange(n + 1)]
        self.mask, self.pattern = [np.full(n, _FULL)], [fp]
        width = 1
        while deepest >= width or len(self.first) == 1:
            width *= FAN
            starts = np.flatnonzero(place % width == 0)
            kids = np.searchsorted(self.first[-1], starts)
            a = np.bitwise_and.reduceat(self.pattern[-1] & self.mask[-1], kids)
            # A bit is shared if all below have it known and equal.
            known = np.bitwise_and.reduceat(self.mask[-1], kids)
            any1 = np.bitwise_or.reduceat(self.pattern[-1], kids)
            mask = known & ~(a ^ any1)
            self.first.append(starts)
            self.child.append(np.append(kids, len(self.first[-2])))
            self.mask.append(mask)
            self.pattern.append(a & mask)
        self.levels = len(self.first)
        self._spans()

    def _spans(self) -> None:
        """Least and greatest component below every node."""
        self.low, self.high = [], []
        for f in self.first:
            self.low.append(np.minimum.reduceat(self.label, f))
            self.high.append(np.maximum.reduceat(self.label, f))

    def _union(self, u: np.ndarray, v: np.ndarray) -> None:
        lab = self.label
        while True:
            a, b = lab[u], lab[v]
            odd = a != b
            if not odd.any():
                break
            u, v, a, b = u[odd], v[odd], a[odd], b[odd]
            m = np.minimum(a, b)
            np.minimum.at(lab, a, m)
            np.minimum.at(lab, b, m)
            while True:
                jump = lab[lab]
                if np.array_equal(jump, lab):
                    break
                lab[:] = jump

    def _end(self, level: int, node: np.ndarray) -> np.ndarray:
        f = self.first[level]
        return np.append(f, len(self.fp))[node + 1]

    def search(self, step: int = 1 << 18) -> np.ndarray:
        """Component label (a leaf) of every leaf, by linked fingerprints."""
        if len(self.fp) < 2:
            return self.label
        top = self.levels - 1
        n = len(self.first[top])
        zero = np.zeros(n, np.uint64)
        todo = [(top, np.arange(n), np.arange(n), np.zeros(n, np.uint8), zero)]
        while todo:
            level, a, b, acc, known = todo.pop()
            if len(a) > step:
                todo.append((level, a[step:], b[step:], acc[step:], known[step:]))
                a, b, acc, known = a[:step], b[:step], acc[:step], known[:step]
            low, high = self.low[level], self.high[level]
            walk = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, acc, known = a[walk], b[walk], acc[walk], known[walk]
            if not len(a):
                continue
            both = self.mask[level][a] & self.mask[level][b]
            acc = acc + np.bitwise_count((self.pattern[level][a] ^ self.pattern[level][b]) & both & ~known)
            keep = acc <= self.d
            a, b, acc, both = a[keep], b[keep], acc[keep], both[keep]
            whole = acc.astype(np.int64) + np.bitwise_count(~both) <= self.d
            if whole.any():
                self._link(level, a[whole], b[whole])
                a, b, acc, both = a[~whole], b[~whole], acc[~whole], both[~whole]
            if level and len(a):
                kid = self.child[level]
                na, nb = kid[a + 1] - kid[a], kid[b + 1] - kid[b]
                pairs = na * nb
                k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                w = np.repeat(np.arange(len(a)), pairs)
                ca, cb = kid[a][w] + k // nb[w], kid[b][w] + k % nb[w]
                one = ca <= cb if level > 1 else ca < cb
                todo.append((level - 1, ca[one], cb[one], acc[w][one], both[w][one]))
        return self.label

    def _link(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        f = self.first[level]
        nodes = np.unique(np.concatenate([a, b]))
        size = self._end(level, nodes) - f[nodes]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(f[nodes], size)
        self._union(np.concatenate([f[a], np.repeat(f[nodes], size)]), np.concatenate([f[b], inner]))
        self._spans()


def _edges(frames: Iterator[pd.DataFrame], d: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (gid, rank) -> one edge from each linked member to the
    first of its component.  Whole groups are indexed, many at a time."""
    held: list[pd.DataFrame] = []
    rows = 0

    def emit(e: pd.DataFrame) -> pd.DataFrame:
        gid, fp = e["gid"].to_numpy(), e["fp"].to_numpy()
        same = np.concatenate(([False], gid[1:] == gid[:-1]))
        shared = same | np.concatenate((same[1:], [False]))  # groups of one have no partner
        gid, fp = gid[shared], fp[shared]
        if not len(fp):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        label = _Index(gid, fp.view(np.uint64), d).search()
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    for f in frames:
        if not len(f):
            continue
        held.append(f)
        rows += len(f)
        if rows >= 100_000 and held[0]["gid"].iloc[0] != f["gid"].iloc[-1]:
            e = pd.concat(held)
            cut = int(np.flatnonzero(e["gid"].to_numpy() != e["gid"].iloc[-1])[-1]) + 1
            yield emit(e.iloc[:cut])
            held, rows = [e.iloc[cut:]], len(e) - cut
    if rows:
        yield emit(pd.concat(held))


def links(distinct: DataFrame, d: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``d`` bits."""
    g = grouped(distinct, d, hot)
    g = g.repartition("gid").sortWithinPartitions("gid", "rank").select("gid", "fp")
    return g.mapInPandas(lambda it: _edges(it, d), "a long, b long")


def near_groups(docs: DataFrame, n: int = SHINGLE, d: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, uid, fp, component_id and the
    component's first row w (by doc_id, nulls last)."""
    slim = write_shared(fingerprints(docs, n).withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("w")
    per_fp = write_shared(slim.groupBy("fp").agg(first, F.count("*").alias("n")), "distinct-fp")
    comp = components(links(per_fp.select("fp"), d, hot))
    named = (per_fp.join(comp, F.col("fp") == F.col("node"), "left")
             .select("fp", F.coalesce("component", "fp").alias("component"), "w", "n"))
    best = named.groupBy("component").agg(F.min("w").alias("best"), F.sum("n").alias("group_size"))
    named = write_shared(named.join(best, "component").select(
        F.col("fp").alias("of"), F.col("best").alias("w"), "group_size"), "named-fp")
    return (slim.join(named, F.col("fp") == F.col("of"))
            .select("doc_id", "key", "uid", "fp", F.col("w.doc_id").alias("component_id"), "group_size", "w"))


def near_dedup(docs: DataFrame, n: int = SHINGLE, d: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id."""
    g = near_groups(docs, n, d, hot).filter("group_size > 1")
    g = write_shared(g.select("doc_id", "key", (F.col("uid") == F.col("w.uid")).alias("kept")), "decided-near")
    return keep_decided(docs, g, F.xxhash64)
