"""Repeated passages against brute force over all windows of 50 words."""
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import suffix_dedup as S


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, length=S.LENGTH):
    """(id, start, end) of joined windows that another text has, or another document with the same text."""
    rows = list(dict.fromkeys(rows))
    where = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - length + 1):
            where.setdefault(tuple(w[a:a + length]), set()).add((i, t))
    out = set()
    for i, t in rows:
        w, spans = words(t), []
        for a in range(len(w) - length + 1):
            others = {(j, u) for j, u in where[tuple(w[a:a + length])] if (j, u) != (i, t)}
            if any(u != t or j != i for j, u in others):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + length
                else:
                    spans.append([a, a + length])
        out |= {(i, a, b) for a, b in spans}
    return out


def some(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(500)]
    text = lambda k: r.choices(vocab, k=k)
    shared = [text(n) for n in (49, 50, 51, 64, 90, 300)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = list(r.choice(shared)) if r.random() < 0.6 else text(r.randint(5, 120))
            if r.random() < 0.3:  # a piece of the passage only, or one with changed words
                p = p[r.randint(0, 20):len(p) - r.randint(0, 20)]
            if r.random() < 0.3 and p:
                p[r.randrange(len(p))] = "changed"
            parts += p + text(r.choice([0, 1, 3]))
        rows.append((i, " ".join(parts)))
    same = " ".join(text(70))
    return rows + [(100, same), (101, same), (102, same), (103, same), (103, same), (104, None), (105, ""), (106, "ha " * 400),
                   (107, "ha " * 300 + "x"), (None, " ".join(shared[4])), (None, "short"), (108, " ".join(text(60) * 3)),
                   (109, "\t".join(shared[5] + text(20_000)))]


@pytest.mark.parametrize("seed,run_rows,buffer,parts", [(1, 50_000, 50_000, "1"), (2, 40, 30, "8"), (3, 5, 7, "3"), (4, 1, 1, "8"), (5, 10, 50_000, "16")])
def test_spans(spark, monkeypatch, seed, run_rows, buffer, parts):
    monkeypatch.setattr(S, "RUN_ROWS", run_rows)
    monkeypatch.setattr(S, "BUFFER_ROWS", buffer)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = some(seed)
        got = S.passages(docs_of(spark, rows, CLASH)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == brute(rows) and len(got) == len(brute(rows))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(words(t))
    for r in got:
        assert r.other_id != r.doc_id or r.doc_id is None
        if r.other_id is not None:
            mine = {tuple(w[a:a + 50]) for w in texts[r.doc_id] for a in range(max(r.start_word, 0), min(r.end_word, len(w)) - 49)}
            assert any(tuple(w[a:a + 50]) in mine for w in texts[r.other_id] for a in range(len(w) - 49))


def test_minimisers_cover_every_passage():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 40, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = S.minimisers(w, np.zeros(5000, np.int64), 1)
    for a in range(0, 5000 - S.LENGTH):
        assert ((m >= a) & (m < a + S.WINDOW)).any()


def test_empty(spark):
    assert S.passages(docs_of(spark, [])).count() == 0


def _counts(spark, monkeypatch, rows, parts, run_rows):
    """Rows of the context and window tables."""
    n = {}

    def kept(df, label, write=S.write_shared):
        out = write(df, label)
        if label in ("contexts", "windows"):
            n[label] = out.count()
            if label == "windows":
                n["open"] = out.filter("not settled").count()
        return out
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        with monkeypatch.context() as m:
            m.setattr(S, "write_shared", kept)
            m.setattr(S, "RUN_ROWS", run_rows)
            got = S.passages(docs_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    return n, {(r.doc_id, r.start_word, r.end_word) for r in got}


def test_windows_are_in_proportion_to_contexts(spark, monkeypatch):
    """A passage that all texts share, near copies with a change each, and pairs."""
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    common, template = r.choices(vocab, k=80), r.choices(vocab, k=150)
    rows = []
    for i in range(300):
        w = r.choices(vocab, k=60) + common + r.choices(vocab, k=60)
        if i % 3 == 0:
            w = list(template)
            w[r.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    for parts in ("1", "8", "64"):
        n, got = _counts(spark, monkeypatch, rows, parts, S.RUN_ROWS)
        assert got == want and n["open"] == 0 and n["windows"] <= n["contexts"]
        n, got = _counts(spark, monkeypatch, rows, parts, 50)  # long runs are cut
        assert got == want and n["windows"] <= 8 * n["contexts"]
