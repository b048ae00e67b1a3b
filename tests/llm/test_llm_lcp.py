"""Fingerprints by locally consistent parsing."""
import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import lcp as L


def names(text, level=1):
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return set(L.parse(p, np.array([0, len(p)]), level)[1].tolist())


def test_equal_substrings_share_names_at_any_offset():
    r = random.Random(0)
    rnd = lambda n: "".join(r.choices("abcdefghij klmnop", k=n))
    body = rnd(3000)
    want = names(body, 3)
    for shift in (1, 2, 7, 50, 333):
        got = names(rnd(shift) + body + rnd(200), 3)
        assert len(got & want) > 0.8 * len(want)


def test_colours_differ_and_are_few():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)
    x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    c = L.colours(x, np.array([0, 100, 5000]))
    assert c.max() < 6 and all(a != b for i, (a, b) in enumerate(zip(c, c[1:])) if i + 1 not in (100, 5000))


def test_batches_and_single_texts_agree():
    r = random.Random(5)
    texts = ["", "a", "aa", "ab", "aaaaaaa", "abababab", "é日本", "x" * 5000] + ["".join(r.choices("abc ", k=r.randint(1, 4000))) for _ in range(40)]
    whole = L.sketch(texts)
    for t, row in zip(texts, whole):
        assert (L.sketch([t])[0] == row).all()
    assert not whole[0].any() and all(row.any() for row in whole[1:])


ROWS = [(5, "five " * 300), (2, None), (3, ""), (4, "x"), (9, "日本語のテキスト" * 40), (1, "".join(chr(97 + i * i % 23) for i in range(1001))),
        (7, "seven words are in this short text"), (7, "seven words are in this short text"), (12, "y" * 150_000), (13, None)]


def edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - h] + n[:h]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_edited_texts(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = L.compare_edited(docs_of(spark, ROWS, CLASH)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited(ROWS))
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_null_ids_and_one_row(spark):
    got = L.compare_edited(docs_of(spark, [(None, "abcd"), (1, "efgh")])).collect()
    assert {(r.doc_id, r.edited_sha256) for r in got} == {(1, hashlib.sha256(b"efab").hexdigest()), (None, hashlib.sha256(b"abef").hexdigest())}
    one = L.compare_edited(docs_of(spark, [(1, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert L.compare_edited(docs_of(spark, [])).count() == 0


def test_edited_is_nearer_than_the_next_document(spark, documents):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.compare_edited(df).toPandas()
    assert sorted(zip(got.doc_id, got.n_chars, got.edited_sha256)) == sorted(edited(list(zip(documents.doc_id, documents.text))))
    assert (got.near_edited > got.near_next).mean() > 0.95
    fp = {r.doc_id: r.fingerprint for r in L.fingerprint(df).collect()}
    assert all(fp[i] == f for i, f in zip(got.doc_id, got.fingerprint))
    by_text = {}
    for i, t in zip(documents.doc_id, documents.text):
        by_text.setdefault(t, set()).add(fp[i])
    assert all(len(v) == 1 for v in by_text.values())
