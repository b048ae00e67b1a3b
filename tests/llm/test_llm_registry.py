"""Registered queries: names, and those with SQL against DuckDB."""
import math
import re

import pytest

from tests.conftest import SF_SMALL
from tijara.llm.registry import ORACLES, QUERIES


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert numbers == list(range(1, len(QUERIES) + 1)) and set(ORACLES) <= set(QUERIES)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(map(_norm, r)) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    order = [cols.index(c) for c in df.columns]
    want = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(got, key=repr) == sorted(want, key=repr)
