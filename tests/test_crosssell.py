"""Frequent pairs against brute force; large baskets; the bucket filter."""
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from tijara.operators import crosssell as X

SCHEMA = "basket long, item string"


def brute(rows, share, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    s = max(least, math.ceil(share * len(baskets) - 1e-9))
    one = Counter(i for x in baskets.values() for i in x)
    two = Counter(p for x in baskets.values() for p in itertools.combinations(sorted(x), 2))
    return sorted((a, b, n, one[a], one[b], len(baskets)) for (a, b), n in two.items() if n >= s)


def _rows(seed, baskets=400, items=60, large=()):
    rng = random.Random(seed)
    rows = []
    for b in range(baskets):
        n = rng.choice([1, 2, 3, 5, 9])
        for _ in range(n):
            rows.append((b, f"i{min(items - 1, int(rng.expovariate(0.08)))}"))
    rows += rows[:50] + [(None, "i1"), (3, None), (None, None)]
    for k, m in enumerate(large):
        rows += [(10_000 + k, f"L{j}" if j >= 30 else f"i{j}") for j in range(m)]
    return rows


@pytest.mark.parametrize("share,least,buckets,tile", [(0.01, 2, 1 << 20, 4096), (0, 1, 64, 4096), (0.02, 3, 4096, 4096),
                                                      (0, 2, 1 << 15, 7), (0, 1, 1 << 16, 100)])
def test_like_brute_force(spark, share, least, buckets, tile):
    rows = _rows(1, large=(300, 300, 40))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = X.frequent_pairs(df, min_share=share, min_baskets=least, buckets=buckets, tile=tile).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, share, least)


def test_convolution_counts_like_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    n, m = np.array([50, 3, 0, 120]), np.array([0, 0, 0, 80])
    left, right = rng.integers(0, 1 << 40, n.sum()), rng.integers(0, 1 << 40, m.sum())
    lo, ro = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(m)))
    direct = X.bucket_counts(left, lo, right, ro, 1024)
    monkeypatch.setattr(X, "DIRECT", 10)
    assert (X.bucket_counts(left, lo, right, ro, 1024) == direct).all()
    assert direct.sum() == 50 * 49 // 2 + 3 + 120 * 80


def test_a_basket_of_5000_items_does_not_square(spark):
    """12.5 million pairs are in one basket; rows are made for those in frequent buckets only."""
    rows = [(0, f"x{i}") for i in range(5000)] + [(1, f"x{i}") for i in range(0, 5000, 500)]
    rows += [(2 + i, f"x{i}") for i in range(5000)]  # every item is frequent at 2
    df = spark.createDataFrame(rows, SCHEMA)
    t = time.time()
    got = X.frequent_pairs(df, min_share=0, min_baskets=2, buckets=1 << 24).collect()
    assert sorted((r.item_a, r.item_b) for r in got) == sorted(itertools.combinations(sorted(f"x{i}" for i in range(0, 5000, 500)), 2))
    assert time.time() - t < 60
    # What pass 3 would hand on at a support of 3: nothing, its buckets hold 1 or 2.
    ids = np.arange(5000)
    off, none = np.array([0, 5000]), np.array([0, 0])
    counts = X.bucket_counts(ids, off, ids[:0], none, 1 << 24)
    assert counts.sum() == 5000 * 4999 // 2 and (counts >= 8).mean() < 0.01


def test_measures(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c")]
    r = X.cross_selling(spark.createDataFrame(rows, SCHEMA), min_share=0.5).collect()
    assert [tuple(x) for x in r] == [("a", "b", 2, 0.5, round(2 / 3, 6), 1.0, round(2 * 4 / 6, 6))]


def test_empty(spark):
    assert X.cross_selling(spark.createDataFrame([], SCHEMA)).collect() == []


def _batches(rows, times=1):
    import pyarrow as pa
    b = pa.RecordBatch.from_pydict({"own": pa.array(rows, pa.list_(pa.int64())), "other": pa.array([None] * len(rows), pa.list_(pa.int64()))})
    return [b] * times


def test_counting_holds_and_hands_on_no_more_than_there_is(monkeypatch):
    """Repeated pairs are summed before they are held; buckets without a pair are not sent."""
    monkeypatch.setattr(X, "BLOCK", 50)
    every = np.ones(1 << 20, bool)
    got = list(X._count_pairs(every, 1 << 20)(_batches([[1, 2, 3]] * 40, 30)))
    assert sum(b.num_rows for b in got) == 3 and {c for b in got for c in b["n"].to_pylist()} == {1200}
    sent = list(X._count_buckets(1 << 20)(_batches([[1, 2, 3]] * 40, 30)))
    assert sum(b.nbytes for b in sent) < 1000
    assert X.PIECE * 10 * 10_000 < 1 << 27  # a full Arrow batch of pieces


def test_pairs_that_differ_go_on_in_parts(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 50)
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(40), 5)) for _ in range(300)]
    total = Counter()
    for b in X._count_pairs(np.ones(1 << 20, bool), 1 << 20)(_batches(rows, 2)):
        assert b.num_rows <= 50 * 6
        for a, c, n in zip(*b.to_pydict().values()):
            total[a, c] += n
    assert total == Counter({p: 2 * n for p, n in Counter(p for r in rows for p in itertools.combinations(r, 2)).items()})
