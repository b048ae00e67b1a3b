"""SimHash near-dedup against brute force."""
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import simhash as S
from tijara.llm.graph import components


def fingerprint(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}).encode())
    if not w:
        return 0
    sh = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, d=3):
    par = list(range(len(ids)))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= d:
                par[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = min([v for v in (low.get(r), x) if v is not None], default=None)
    return [low[find(i)] for i in range(len(ids))]


def some():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows, base = [], [" ".join(r.choices(vocab, k=400)) for _ in range(25)]
    for i in range(220):
        t = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((1000 - i, " ".join(t)))
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (6, "É x y"), (None, "a b"), (None, "lonely"), (7, "Q " * 50_000),
                   (8, "q " * 50_001), (9, rows[0][1]), (9, rows[0][1])]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_components(spark, hot):
    rows = some()
    got = S.near_groups(docs_of(spark, rows, CLASH), hot=hot).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(str((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, brute([i for i, _ in rows], fps)))
    assert sorted(str((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id)) for r in got) == want


def test_one_row_stays(spark):
    rows = some()
    df = docs_of(spark, rows, CLASH)
    out = S.near_dedup(df)
    assert out.columns == df.columns
    comp = brute([i for i, _ in rows], [fingerprint(t) for _, t in rows])
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(c) for c in set(comp))


def test_dense_groups_in_the_index():
    rng = np.random.default_rng(4)
    fp = []
    for c in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fp.append(x)
    fp = np.array(sorted(set(fp)), np.uint64)
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fp = fp[np.argsort(rank)]
    gid = np.zeros(len(fp), np.int64)
    for step in (1 << 18, 64):
        label = S._Index(gid, fp, 3).search(step)
        want = brute(list(range(len(fp))), [int(x) for x in fp])
        assert label.tolist() == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    names = {}
    for r in out:
        names.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, names.values())) == [201, 301]


def test_empty(spark):
    df = docs_of(spark, [])
    assert S.near_groups(df).count() == 0 and S.near_dedup(df).count() == 0
