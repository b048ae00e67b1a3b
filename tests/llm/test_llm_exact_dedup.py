"""Exact dedup: brute force, every edge case, and both sides of the split."""
import hashlib
import re

import pytest

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import exact_dedup as X

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (None, "a b"), (1, ""), (2, None), (4, " "), (7, "x"), (7, "x"), (7, "y"),
        (8, "x"), (None, "only"), (None, "only"), (6, "z" * 200_000), (10, "z" * 200_000), (11, "a b c")] + [(100 + i, "hot") for i in range(60)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for i, t in [(r[0], norm(r[1])) for r in rows]:
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_decisions(spark, support):
    got = X.decide(docs_of(spark, ROWS, CLASH), support).collect()
    key = lambda r: (str(r[0]), r[3], str(r[1]))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got], key=key) == sorted(expected(ROWS), key=key)
    kept = {}
    for r in got:
        if r.kept:
            kept.setdefault(r.digest.hex(), []).append(r.doc_id)
            assert r.doc_id == r.keep_id
    assert set(kept) == {e[3] for e in expected(ROWS)} and all(len(v) == 1 for v in kept.values())


def test_documents_kept(spark):
    df = docs_of(spark, ROWS, CLASH)
    out = X.exact_dedup(df)
    assert out.columns == df.columns
    got = [(r.doc_id, norm(r.text)) for r in out.collect()]
    want = {norm(t): min((i for i, u in ROWS if norm(u) == norm(t)), key=lambda i: (i is None, i or 0)) for _, t in ROWS}
    assert sorted(got, key=str) == sorted(((i, t) for t, i in want.items()), key=str)


def test_empty(spark):
    df = docs_of(spark, [])
    assert X.decide(df).count() == 0 and X.exact_dedup(df).count() == 0


def test_plan_has_no_python(spark):
    plan = X.decide(docs_of(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
