"""License scans: brute force for phrases and diagonals, edits, cases."""
import random
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import CLASH, docs_of
from tijara.llm import license_scan as L

PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
MIT = L.NOTICES[0][1]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = tokens(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places})))


def brute(text):
    """Score and labels by plain loops over every template and diagonal."""
    w, score, labels = tokens(text), 0.0, set()
    for _i, label, phrase, t in L.templates():
        at = defaultdict(list)
        for k in range(len(t) - 2):
            at[tuple(t[k:k + 3])].append(k)
        dia = defaultdict(list)
        for p in range(len(w) - 2):
            for k in at.get(tuple(w[p:p + 3]), ()):
                dia[p - k].append((p, k))
        group, before = [], None
        groups = []
        for d in sorted(dia):
            if before is None or d - before > min(8, len(t) // 8):
                group = []
                groups.append(group)
            group.append(dia[d])
            before = d
        for g in groups:
            lo, hi = min(p for x in g for p, _ in x), max(p for x in g for p, _ in x) + 3
            if hi - lo <= max(1.5 * len(t), len(t) + min(8, len(t) // 8)):
                c = len({k for x in g for _, k in x}) / (len(t) - 2)
            else:
                c = max(len(x) for x in g) / (len(t) - 2)
            score = max(score, c)
            if c >= 0.8:
                labels.add(label)
        if phrase and any(len(x) == len(t) - 2 for x in dia.values()):
            labels.add(label)
    return ",".join(sorted(labels)), round(score, 12)


def _edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        r = rng.random()
        if r < 0.4:
            w[i] = "zzz"
        elif r < 0.7:
            del w[i]
        else:
            w.insert(i, "qqq")
    return " ".join(w)


def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, "mit"), (4, "Under the MIT license"), (5, "x under-the_mit\x00license. under the MIT LICENSE"),
           (6, "CC BY-NC cc by nc"), (7, "cc by nc by nc cc-by-nc"), (8, "Apache License, Version 2.0"), (9, "apache license version 20"),
           (10, "undér the mit license under the mit licensé"), (11, MIT), (12, "pre " * 50 + MIT.upper() + " post" * 50),
           (13, "under the mıt license K under the mit license"), (None, "cc by nc"), (None, None), (14, "dup cc by nc"), (14, "dup cc by nc"),
           (15, "cc by nc " * 3000 + "under the mit license " * 2000), (16, "a1" * 500_000), (17, "word " * 200_000 + MIT),
           (18, " ".join([MIT] * 40)), (19, "This work is licensed under the GNU General Public License, version 3."),
           (20, "the software " * 300), (21, "\U0001F600 cc \U0001F600 by nc")]
    for n in range(40):
        _, text = L.NOTICES[rng.randrange(len(L.NOTICES))]
        out.append((100 + n, _edited("start here " + text + " and the end", rng, rng.randrange(8))))
    return out


def test_like_brute_force(spark):
    data = rows()
    got = L.scan(docs_of(spark, data, CLASH)).collect()
    assert len(got) == len(data)
    want = sorted(repr((i, *base(x), *brute(x))) for i, x in data)
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12)))
                  for r in got) == want


def test_edited_notices_keep_their_label_and_span(spark):
    rng = random.Random(11)
    data = [(i, "lorem " * 30 + _edited(MIT, rng, 3) + " ipsum" * 30) for i in range(20)] + [(90, "plain words only " * 60)]
    s = L.spans(docs_of(spark, data)).collect()
    assert {r.doc_id for r in s if r.label == "mit"} == set(range(20)) and all(r.doc_id < 90 for r in s)
    assert all(r.start_word >= 28 and r.end_word - r.start_word <= 80 for r in s)


def test_empty_table(spark):
    assert L.scan(docs_of(spark, [])).collect() == []
    assert L.spans(docs_of(spark, [])).collect() == []


def test_own_templates(spark):
    got = L.scan(docs_of(spark, [(1, "all rights reserved by us"), (2, "x")]), phrases=[("all rights reserved", "closed")], notices=[])
    assert {(r.doc_id, r.labels, r.n_base) for r in got.collect()} == {(1, "closed", 1), (2, "", 0)}
    with pytest.raises(ValueError):
        L.templates(phrases=[("two words", "x")])


def test_no_python_worker_in_the_plan(spark):
    df = L.scan(docs_of(spark, [(1, "cc by nc")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
