"""Cross-selling: products bought together (declared in the source; formulas ours).

Frequent pairs by a bucket filter, in four steps over distinct (basket, item):

1. Item counts.  Only items in ``support`` baskets and more can be in a frequent
   pair; the others go.  With a support that is a share of the baskets, at most
   (items a basket) / share items are left, at any size of the data, and no
   basket is longer than that.
2. A pair falls into the bucket (code of one + code of the other) mod ``buckets``.
   Tasks count pairs a bucket without making rows of them: small baskets by
   sums of codes, large ones as the convolution of their code histogram with
   itself, whose cost does not grow with the square of the basket.  Bucket counts
   are bounds from above for the counts of their pairs.
3. Only pairs in buckets that reach the support are counted themselves, summed
   inside each task before they are shuffled.
4. Pairs that reach the support get support, confidence both ways and lift.

A basket of more than ``TILE`` frequent items is dealt into parts; every two
parts are a row of their own, so that its pairs are many tasks' work.

The bucket filter (one bit a bucket) is the only thing that passes the driver.
Nulls in basket or item are left out; repeated lines count once; ties cannot
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp
from ..session import write_shared
from ..sources.tables import checked_broadcast

BUCKETS = 1 << 20
TILE = 4_096
DIRECT = 2_000_000  # pairs of one row that are summed one by one; beyond, by convolution
BLOCK = 1 << 18  # pairs, or counted pairs, held at once
PIECE = 1 << 10  # buckets a row: an Arrow batch of 10,000 rows stays under 100 MB


def _codes(ids: np.ndarray, buckets: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def _rows(column):
    """Arrow list column -> (flat int64 values, offsets); null lists are empty."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(n)))


def _pairs(left, loff, right, roff):
    """Position pairs (into ``left`` twice, or ``left`` and ``right``) of all rows, in blocks: (x, y, within one list)."""
    n, m = np.diff(loff), np.diff(roff)
    own = m == 0
    for size in np.unique(n[own]):
        if size < 2 or size * (size - 1) // 2 > BLOCK:
            continue
        at = loff[:-1][own & (n == size)]
        i, j = np.triu_indices(size, 1)
        step = max(1, BLOCK // len(i))
        for k in range(0, len(at), step):
            some = at[k:k + step, None]
            yield (some + i).ravel(), (some + j).ravel(), True
    for r in np.flatnonzero(own & (n * (n - 1) // 2 > BLOCK)):
        a = np.arange(loff[r], loff[r + 1])
        step = max(1, BLOCK // len(a))
        for k in range(0, len(a), step):
            x, y = np.meshgrid(a[k:k + step], a[k:], indexing="ij")
            keep = x < y
            yield x[keep], y[keep], True
    for r in np.flatnonzero(~own):
        a, b = np.arange(loff[r], loff[r + 1]), np.arange(roff[r], roff[r + 1])
        step = max(1, BLOCK // len(b))
        for k in range(0, len(a), step):
            x, y = np.meshgrid(a[k:k + step], b, indexing="ij")
            yield x.ravel(), y.ravel(), False


def bucket_counts(left: np.ndarray, loff: np.ndarray, right: np.ndarray, roff: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs a bucket, over all rows."""
    out = np.zeros(buckets, np.int64)
    cl, cr = _codes(left, buckets), _codes(right, buckets)
    n, m = np.diff(loff), np.diff(roff)
    large = np.where(m == 0, n * (n - 1) // 2, n * m) > DIRECT
    for r in np.flatnonzero(large):
        a = np.bincount(cl[loff[r]:loff[r + 1]], minlength=buckets)
        fa = np.fft.rfft(a)
        if m[r]:
            fb = np.fft.rfft(np.bincount(cr[roff[r]:roff[r + 1]], minlength=buckets))
            out += np.rint(np.fft.irfft(fa * fb, buckets)).astype(np.int64)
        else:
            both = np.rint(np.fft.irfft(fa * fa, buckets)).astype(np.int64)
            both -= np.bincount(2 * cl[loff[r]:loff[r + 1]] % buckets, minlength=buckets)  # an item with itself
            out += both // 2
    # The other rows one after the other, lists of large ones emptied.
    keep = np.repeat(~large, n)
    keep_r = np.repeat(~large, m)
    sl, so = cl[keep], np.concatenate(([0], np.cumsum(np.where(large, 0, n))))
    sr, ro = cr[keep_r], np.concatenate(([0], np.cumsum(np.where(large, 0, m))))
    for x, y, own in _pairs(sl, so, sr, ro):
        out += np.bincount((sl[x] + (sl[y] if own else sr[y])) % buckets, minlength=buckets)
    return out


def _count_buckets(buckets: int):
    def run(batches):
        """(piece, places in it, their counts), buckets without a pair left out."""
        import pyarrow as pa
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += bucket_counts(*_rows(b.column(0)), *_rows(b.column(1)), buckets)
        for k in range(0, buckets, PIECE):
            at = np.flatnonzero(total[k:k + PIECE])
            if len(at):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // PIECE], pa.int32()),
                                                  "places": pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                                  "counts": pa.array([total[k + at].tobytes()], pa.binary())})
    return run


def _frequent_buckets(support: int):
    def run(batches):
        """Counts of pieces -> one bit a bucket."""
        import pyarrow as pa
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, places, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if piece not in total:
                    total[piece] = np.zeros(PIECE, np.int64)
                total[piece][np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()),
                                              "bits": pa.array([np.packbits(t >= support).tobytes() for t in total.values()], pa.binary())})
    return run


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(n, first)


def _count_pairs(bits: np.ndarray, buckets: int):
    def run(batches):
        import pyarrow as pa
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # counted pairs, in parts of different ones
        n = 0

        def batch_of(p):
            return pa.RecordBatch.from_pydict({"a": p[0], "b": p[1], "n": p[2]})

        for batch in batches:
            left, loff = _rows(batch.column(0))
            right, roff = _rows(batch.column(1))
            cl, cr = _codes(left, buckets), _codes(right, buckets)
            for x, y, own in _pairs(left, loff, right, roff):
                k = np.flatnonzero(bits[(cl[x] + (cl[y] if own else cr[y])) % buckets])
                if not len(k):
                    continue
                a, b = left[x[k]], (left if own else right)[y[k]]
                held.append(_summed(np.minimum(a, b), np.maximum(a, b), np.ones(len(k), np.int64)))
                n += len(held[-1][0])
                if n > BLOCK:
                    held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                    n = len(held[0][0])
                    if n > BLOCK // 2:  # mostly different pairs: they go on
                        yield batch_of(held[0])
                        held, n = [], 0
        if held:
            yield batch_of(_summed(*(np.concatenate(c) for c in zip(*held))))
    return run


def _tiles(slim: DataFrame, tile: int) -> DataFrame:
    """(basket, id) -> (own, other): a row for each basket, or for every two parts of a large one."""
    size = slim.groupBy("basket").agg(F.count("*").alias("size")).filter("size > 1")
    large = write_shared(size.filter(F.col("size") > tile).select(F.col("basket").alias("of"), F.ceil(F.col("size") / tile).cast("int").alias("parts")), "large-baskets")
    slim = slim.join(checked_broadcast(large, 10_000), F.col("basket") == F.col("of"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))
    g = (slim.withColumn("part", part).groupBy("basket", "part")
         .agg(F.collect_list("id").alias("own"), F.max("parts").alias("parts")))
    g = write_shared(g.filter((F.size("own") > 1) | F.col("parts").isNotNull()), "basket-parts")
    none = F.lit(None).cast("array<long>")
    one = g.filter(F.size("own") > 1).select("own", none.alias("other"))
    cut = g.filter("parts is not null")
    two = cut.join(cut.select(F.col("basket").alias("of"), F.col("part").alias("p2"), F.col("own").alias("other")),
                   (F.col("basket") == F.col("of")) & (F.col("part") < F.col("p2"))).select("own", "other")
    return one.unionByName(two)


def frequent_pairs(baskets: DataFrame, min_share: float = 0.001, min_baskets: int = 2, buckets: int = BUCKETS,
                   tile: int = TILE) -> DataFrame:
    """``baskets``: (basket, item) lines.  item_a < item_b, together (baskets with both), n_a, n_b, n_baskets, for pairs in at
    least ``min_share`` of all baskets and in ``min_baskets``."""
    spark = baskets.sparkSession
    b = write_shared(baskets.select("basket", "item").filter("basket is not null and item is not null").distinct(), "baskets")
    total = b.agg(F.countDistinct("basket")).first()[0]
    support = max(min_baskets, math.ceil(min_share * total - 1e-9))
    items = write_shared(b.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
                         .withColumn("id", F.monotonically_increasing_id()), "frequent-items")
    slim = b.join(items.select("item", "id"), "item").select("basket", "id")
    tiles = write_shared(_tiles(slim, tile).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "basket-tiles")
    counts = tiles.mapInArrow(_count_buckets(buckets), "piece int, places binary, counts binary").repartition("piece")
    bits = np.zeros(buckets, bool)
    for r in counts.mapInArrow(_frequent_buckets(support), "piece int, bits binary").collect():
        at = r["piece"] * PIECE
        got = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)[:buckets - at]
        bits[at:at + PIECE] = got[:PIECE]
    pairs = (tiles.mapInArrow(_count_pairs(bits, buckets), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("together"))
             .filter(F.col("together") >= support))
    x = items.select(F.col("id").alias("a"), F.col("item").alias("x"), F.col("n").alias("nx"))
    y = items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n").alias("ny"))
    p = pairs.join(x, "a").join(y, "b")
    first = F.col("x") < F.col("y")
    return p.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "together",
                    F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("n_a"),
                    F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("n_b"), F.lit(total).cast("long").alias("n_baskets"))


def cross_selling(baskets: DataFrame, **how) -> DataFrame:
    """Frequent pairs with support, confidence of either product given the other, and lift."""
    p = frequent_pairs(baskets, **how)
    t, a, b, n = (F.col(c).cast("double") for c in ("together", "n_a", "n_b", "n_baskets"))
    return p.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), F.col("together").alias("orders"),
                    round_dp(t / n, 9).alias("support"), round_dp(t / a, 6).alias("confidence_ab"), round_dp(t / b, 6).alias("confidence_ba"),
                    round_dp(t * n / (a * b), 6).alias("lift"))
