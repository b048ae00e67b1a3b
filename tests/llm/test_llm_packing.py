"""Packing: ids by the tokenizer itself, exact round trip, tight sequences."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import packing as P


def ids_of(text):
    from tokenizers import Tokenizer
    if not hasattr(ids_of, "tok"):
        ids_of.tok = Tokenizer.from_file(P.tokenizer_path())
    return ids_of.tok.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, cap):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    return len(seqs)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "Straße ÀÉ <|endoftext|> don't x y\x1cz 123 ﬁ é"), (5, "word " * 5000),
       (5, "word " * 5000), (None, "no id"), (6, "日本語 text"), (7, "a" * 30_000)]


@pytest.mark.parametrize("cap", [16, 2048])
def test_round_trip(spark, cap):
    df = P.pack_documents(docs_of(spark, ODD, CLASH), cap=cap, keep_ids=True, per_task=7)
    rows = df.collect()
    want = []
    for i, t in ODD:
        ids = ids_of(t)
        want += [(i, k // cap, k, ids[k:k + cap]) for k in range(0, len(ids), cap)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, list(r.ids))) for r in rows)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    check(rows, cap)


def test_words_beyond_the_cache(spark, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 5)
    enc = P._Words(None)
    texts = [f"alpha beta {i} gamma delta{i} epsilon zeta eta theta" for i in range(40)]
    got = []
    for i in range(0, 40, 4):
        part = [t.encode() for t in texts[i:i + 4]]
        ids, ends = enc.encode(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(t) for t in part]))
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [ids_of(t) for t in texts] and len(enc) <= 5 and len(enc.units) <= 10


@pytest.mark.parametrize("per_task", [10**6, 400])
def test_as_few_as_best_fit(spark, per_task):
    r = random.Random(1)
    lengths = [min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(4000)] + [700] * 1500 + [1365] * 700
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long")
    out = P.pack(df, per_task=per_task).join(df, "uid").collect()
    assert len(out) == len(lengths)
    gaps, bins = [], 0
    import bisect
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k < len(gaps):
            g = gaps.pop(k)
        else:
            g, bins = 2048, bins + 1
        bisect.insort(gaps, g - n)
    assert check(out, 2048) <= bins * 1.01 + 1


def test_empty(spark):
    assert P.pack_documents(docs_of(spark, [])).count() == 0


def test_whole_table(spark, documents):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.pack_documents(df).collect()
    want = {d: len(ids_of(t)) for d, t in zip(documents.doc_id, documents.text)}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert check(rows, 2048) <= -(-sum(want.values()) // 2048) + 1
    assert df.select(F.count("*")).first()[0] == len(got)
