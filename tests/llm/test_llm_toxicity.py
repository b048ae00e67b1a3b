"""Toxicity: maximal segments by brute force, accuracy on the held-out fold."""
import random
import zlib

import pandas as pd
import pytest

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import queries, toxicity as T


def brute(scores):
    """Ruzzo-Tompa by its definition: split at the best segment, again and again."""
    def rec(lo, hi):
        best, at = 0.0, None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > best + 1e-12:
                    best, at = total, (a, b)
        if at is None:
            return []
        return rec(lo, at[0]) + [(best, *at)] + rec(at[1] + 1, hi)
    return rec(0, len(scores))


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    r = random.Random(seed)
    n, drift = 40, 0.3
    hits = [(i, r.uniform(-2, 3)) for i in range(n) if r.random() < 0.5]
    flat = [-drift] * n
    for i, s in hits:
        flat[i] += s
    got, want = T.segments(hits, drift), brute(flat)
    assert len(got) == len(want)
    for (s, a, b), (t, c, d) in zip(got, want):
        assert abs(s - t) < 1e-9 and (a, b) == (c, d)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_toxicity(spark, sf).toPandas()
    docs, lab = pd.read_parquet(sf + "/documents.parquet"), pd.read_parquet(sf + "/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out))
    x = got.merge(lab, on="doc_id")
    test = x[x.held_out]
    assert (test.predicted == test.toxic).mean() > max(1 - test.toxic.mean(), 0.93)
    assert test[test.toxic == 1].score.mean() > test[test.toxic == 0].score.mean() + 0.4


TOXIC = "you are a worthless clown"
_R = random.Random(4)
_VOCAB = ["".join(_R.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)]


def _text(i):
    words = _R.choices(_VOCAB, k=40)
    for w in ("worthless", "clown") if i % 4 == 0 else ("good", "friend"):
        words.insert(_R.randrange(len(words)), w)
    return " ".join(words)


ROWS = [(i, _text(i)) for i in range(240)]
ROWS += [(900, None), (901, ""), (902, "123 456"), (None, TOXIC), (903, " ".join(_VOCAB) + " " + TOXIC),
         (904, " ".join(_VOCAB * 200) + " " + TOXIC), (4, ROWS[4][1])]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_cases(spark):
    docs = docs_of(spark, ROWS, CLASH)
    lab = labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(240)] + [(None, 1, 1), (3, 1, None), (901, 1, 0), (900, None, 0)])
    model = T.fit(docs, lab)
    got = T.score_documents(docs, model).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[4].score > 0.5 > by[5].score and by[None].score > 0.5 and by[900].score == by[901].score == by[902].score < 0.5
    assert by[903].score > 0.5 and any("clown" in ROWS[-3][1][p.start:p.end] for p in by[903].passages)
    assert 0 <= by[904].score <= 1  # among so many words a few such words may be chance
    out = T.reject_toxic(docs, lab)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = docs_of(spark, ROWS)
    rows = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    a, b = T.fit(docs, labels_of(spark, rows)), T.fit(docs, labels_of(spark, turned))
    assert a == b


def test_no_labels_and_empty(spark):
    docs = docs_of(spark, ROWS)
    assert {r.score for r in T.score_documents(docs, T.fit(docs, labels_of(spark, []))).collect()} == {0.0}
    one = T.fit(docs, labels_of(spark, [(i, 1, 1) for i in range(50)]))
    assert {r.score for r in T.score_documents(docs, one).collect()} == {1.0}
    none = docs_of(spark, [])
    assert T.score_documents(none, T.fit(none, labels_of(spark, []))).count() == 0
    assert T.reject_toxic(none, labels_of(spark, [])).count() == 0


def test_every_passage_of_a_long_document_is_found(spark):
    """A passage of words that stood before, together or scattered, counts like the first."""
    model = T.fit(docs_of(spark, ROWS), labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(240)]))
    filler = " ".join(_VOCAB * 2)
    twice = f"{filler} {TOXIC} {filler} {TOXIC} {filler}"
    one, two = sorted(next(iter(model.score([twice])))[1])
    assert all("worthless clown" in twice[a:b] for a, b, _ in (one, two)) and one[1] < two[0] and abs(one[2] - two[2]) < 1e-9
    scattered = f"worthless {filler} clown {filler}"
    dense = next(iter(model.score([f"{scattered} {TOXIC} {filler}"])))[1]
    assert any(a > len(scattered) for a, _, _ in dense)
