"""Fill-in-the-middle: brute force over code points, round trip, cases."""
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tijara.llm import fim
from tijara.llm.registry import QUERIES

from tests.llm.conftest import CLASH, docs_of


def brute(doc_id, text, unit="line", rate=100, spm=50, seed="7"):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [(1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "a\nb"), (6, "a\nb\n"), (7, "é\nßx\n漢字\n😀z"), (8, "has <P> in it\nx"),
        (9, "<M>"), (10, "<S"), (11, "\r\n\x0b\x85 q"), (12, "one line only ñ"), (None, "null id\nhere\n"),
        (None, None), (13, "same\nid"), (13, "same\nid"), (14, "<\n<P\n<S\n<M"), (15, "é" * 3000 + "\n" + "漢\n" * 5000),
        (16, "word " * 400_000 + "\nend"), (17, "x\n" * 300_000)] + [(100 + i, f"l{i}é\nß\n" * (i % 7) + "t") for i in range(60)]


def key(r):
    return repr(r[:5]) + hashlib.sha256(r[5].encode()).hexdigest()


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("char", 100, 50), ("line", 60, 10), ("char", 30, 90)])
def test_like_brute_force_over_code_points(spark, unit, rate, spm):
    df = docs_of(spark, ROWS, CLASH)
    t = fim.transform(df, unit=unit, rate=rate, spm=spm)
    got = [tuple(r) for r in t.collect()]
    want = [brute(i, x, unit, rate, spm) for i, x in ROWS]
    assert sorted(map(key, got)) == sorted(map(key, want))
    back = t.select("doc_id", fim.restored(t.output, t.form).alias("text")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), x or "") for i, x in ROWS)


def test_all_forms_occur(spark):
    forms = {r.form for r in fim.transform(docs_of(spark, ROWS)).select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table(spark):
    t = fim.transform(docs_of(spark, []))
    assert t.collect() == [] and t.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_sentinels_must_be_told_apart(spark):
    with pytest.raises(ValueError):
        fim.transform(docs_of(spark, []), sentinels=("<P>", "<P>>", "<M>"))
    with pytest.raises(ValueError):
        fim.transform(docs_of(spark, []), unit="word")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_index_converts_both_ways(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    index = fim.ExceptionIndex(buf)
    begins = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.chars(np.array(begins)).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == begins


def test_ascii_index_is_empty():
    assert len(fim.ExceptionIndex(np.frombuffer(b"plain text\n" * 9, np.uint8)).at) == 0


def test_query_over_the_whole_table(spark, documents):
    from tests.conftest import SF_SMALL
    got = QUERIES["op11_fill_in_middle"](spark, SF_SMALL).toPandas()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, x in zip(documents.doc_id, documents.text):
        b = brute(int(i), x)
        want[int(i)] = (*b[1:5], sha(b[5]), sha(x or ""))
    assert len(got) == len(want)
    for r in got.itertuples():
        none = lambda v: None if v != v or v is None else int(v)
        assert (r.n, r.form, none(r.prefix_chars), none(r.middle_chars), r.output_sha256, r.restored_sha256) == want[r.doc_id]
