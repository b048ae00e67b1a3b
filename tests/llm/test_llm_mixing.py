"""Mixing: targets by brute force, whole words taken, positions by integration."""
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import mixing as M


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes, share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]))
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if limit * sizes[n] <= level * weight[n]]
        if not over:
            target.update({n: level * weight[n] for n in open_})
            break
        for n in over:
            target[n] = limit * sizes[n]
            left -= target[n]
            open_.remove(n)
    return target


def some(n=300, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 40, 200]))),
             r.choice(["b", "a", "a", "a", "a", "é", "z", None])) for i in range(n)]
    return rows + [(None, "one two", "a"), (n, None, "b"), (7, "again and again", "a"), (7, "again and again", "a"), (n + 1, "x " * 9, "tiny")]


def test_taken_meets_targets(spark):
    rows = some()
    docs = docs_of(spark, rows, CLASH)
    slim = M.measured(docs)
    got = M.assign(slim, slim).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    target = water(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = max(size(r[1]) for r in rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest / 2 + 1e-6
        # No document could be left out, or taken, to come nearer at the end of the demand.
    assert all(r.taken % r["size"] == 0 for r in got if r["size"])
    again = M.assign(M.measured(docs.repartition(7)), M.measured(docs)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, [(r.doc_id, r["size"], r.taken) for r in got])) == sorted(map(str, [tuple(r) for r in again]))


def test_positions_invert_the_schedule(spark):
    cycle = [(5.0, M.EARLY), (2.0, M.STEADY), (1.0, M.LATE)]
    ranks = spark.range(3).withColumn("s", M._schedule(F.col("id"), cycle))
    ys = [0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0]
    for r in ranks.select("id", *[M.invert(F.col("s"), F.lit(y)).alias(f"y{i}") for i, y in enumerate(ys)]).collect():
        knots = cycle[r.id][1]

        def used(t):
            n, total = 20_000, 0.0
            for i in range(n):
                x = t * (i + 0.5) / n
                for (a, u), (b, v) in zip(knots, knots[1:]):
                    if a <= x <= b:
                        total += (u + (v - u) * (x - a) / (b - a)) * t / n
                        break
            return total
        for i, y in enumerate(ys):
            assert abs(used(r[f"y{i}"]) - y) < 1e-3


def test_mixed_documents(spark):
    rows = some(120, 5)
    docs = docs_of(spark, rows, CLASH)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    slim = M.measured(docs)
    want = M.assign(slim, slim).collect()
    assert sum(size(r.text) for r in got) == sum(r.taken for r in want)
    assert len(got) == sum(len(r.copies) for r in want)
    # Every text of the mix is its document's text.
    every = {(i, t) for i, t, _ in rows}
    assert all((r.doc_id, r.text) in every for r in got)


def test_rows_without_an_id_are_many_buckets(spark):
    rows = [(None, f"text number {i}", "a") for i in range(400)] + [(7, f"other {i}", "a") for i in range(400)]
    slim = M.measured(docs_of(spark, rows))
    buckets = M._keyed(slim, M.SEED, 28).groupBy("bucket").count().collect()
    assert len(buckets) == 28 and max(r["count"] for r in buckets) < 80


def test_empty_and_zero(spark):
    docs = docs_of(spark, [])
    assert M.mix(docs).count() == 0
    only = docs_of(spark, [(1, None), (2, " ")])
    slim = M.measured(only)
    assert [r.taken for r in M.assign(slim, slim).collect()] == [0, 0] and M.mix(only).count() == 0
