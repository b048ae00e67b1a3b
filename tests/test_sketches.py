"""Mergeable profile: documented errors, merge against one pass, repeated loads."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tijara.operators import sketches as S


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = [(i % 4, f"v{rng.randrange(9000)}" if rng.random() < 0.9 else None, str(rng.gauss(0, 50)), None, "text") for i in range(20_000)]
    rows += [(None, "x", "12", None, "9"), (0, None, "not a number", None, "NaN")]
    return spark.createDataFrame(rows, "load long, word string, number string, nothing string, mixed string").repartition(5)


def _check(got, frame, columns=("word", "number", "nothing", "mixed")):
    for c in columns:
        r = got[c]
        exact = frame.agg(F.count("*"), F.count_if(F.col(c).isNull()), F.countDistinct(c)).first()
        assert (r.rows, r.missing) == (exact[0], exact[1])
        assert abs(r.distinct_values - exact[2]) <= S.DISTINCT_ERROR * exact[2] + 0.5
        numbers = sorted(x for x, in frame.select(F.col(c).try_cast("double")).collect() if x is not None and x == x)
        assert r.n_numbers == len(numbers)
        if not numbers:
            assert r.low is None and r.quantiles == [None] * 3
            continue
        assert (r.low, r.high) == (numbers[0], numbers[-1])
        for p, q in zip((0.25, 0.5, 0.75), r.quantiles):
            below, upto = sum(x < q for x in numbers) / len(numbers), sum(x <= q for x in numbers) / len(numbers)
            assert below - S.RANK_ERROR <= p <= upto + S.RANK_ERROR


def test_loads_merge_to_the_profile_of_their_union(spark, frame):
    path = tempfile.mkdtemp(prefix="tijara-test-") + "/profile"
    cols = ["word", "number", "nothing", "mixed"]
    S.append(frame.filter("load < 2"), path, F.col("load"), cols)
    S.append(frame.filter("load >= 2 or load is null"), path, F.col("load"), cols)
    got = {r.column: r for r in S.merged(S.read(spark, path)).collect()}
    assert set(got) == set(cols)
    _check(got, frame)
    one = {r.column: r for r in S.merged(S.profile(frame, F.lit("all"), cols)).collect()}
    _check(one, frame)
    assert all((got[c].rows, got[c].missing, got[c].low, got[c].high) == (one[c].rows, one[c].missing, one[c].low, one[c].high) for c in cols)
    # A load that is stored again replaces itself.
    S.append(frame.filter("load = 1"), path, F.col("load"), cols)
    again = {r.column: r for r in S.merged(S.read(spark, path)).collect()}
    assert all((again[c].rows, again[c].distinct_values) == (got[c].rows, got[c].distinct_values) for c in cols)


def test_empty(spark):
    df = spark.createDataFrame([], "a string")
    assert S.merged(S.profile(df, F.lit("x"))).collect() == []
