"""Conversation repair: brute force, both paths, collisions, cases."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pandas as pd
import pytest

from tests.conftest import SF_SMALL
from tijara.llm import conversation_repair as R
from tijara.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits) by recursion over whole strings, from the end."""
    @lru_cache(None)
    def go(i, state, put_in):
        out = []
        if i == len(rows) and state in "0a":
            out.append((0, ""))
        nxt = "a" if state == "u" else "u"
        if put_in < 3:
            c, s = go(i, nxt, put_in + 1)
            out.append((c + 3, "I" + s))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            c, s = go(i + 1, state, 0)
            out.append((c + 4, "D" + s))
            if not must_go:
                extra = 3 if truncated else 0
                if initial == nxt or (initial == "s" and state == "0"):
                    c, s = go(i + 1, initial, 0)
                    out.append((c + extra, "K" + s))
                c, s = go(i + 1, nxt, 0)
                out.append((c + 3 + extra, "R" + s))
        return min(out) if out else (10**9, "")
    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in "0sua":
            go(i, state, 0)
    return go(0, "0", 0)


def damaged(rows):
    """Rows (conv, turn, role, text) -> the same after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def brute(convs):
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, flags, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _turn, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(tuple(flags))
        state, k, lines = "", 0, []
        for e in audit:
            nxt = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{nxt}:")
            elif e == "R":
                lines.append(f"{nxt}:{rows[k][2]}")
            elif e == "K":
                lines.append(f"{rows[k][1]}:{rows[k][2]}")
            if e != "D":
                state = lines[-1][:1]
            k += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", " \t", None, "Same!", "a\nb?", "é!  \n", f"t{rng.randrange(3)}.", ""])
            turn = rng.choice([t, t, t, t + 1, 2 * t, None])
            rows.append((c, turn, role, text))
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, None, None), (7000, None, "user", "x.")]
    # A conversation that loses all its rows.
    rows += [(c, 0, "user", "Gone.") for c in range(8000, 8200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


def frame(spark, rows, clash=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in clash:
        df = df.withColumn(name, df.conv_id.cast("string"))
    return df.repartition(3) if rows else df


def answer(spark, df, **how):
    a = R.repair(R.damage(df), **how).audits()
    assert a.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(repr(tuple(r)) for r in a.collect())


@pytest.mark.parametrize("how", [{}, {"long_rows": 3, "stretch": 2}, {"long_rows": 0, "stretch": 1}, {"long_chars": 5, "stretch": 100}])
def test_like_brute_force_on_both_paths(spark, how):
    rows = random_rows(3)
    df = frame(spark, rows, ("conv", "of", "uid", "digest", "kind", "task", "_c0", "first", "role2"))
    assert answer(spark, df, **how) == brute(damaged(rows))


def test_long_conversation_is_cut_into_stretches(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"m{rng.randrange(300)}" + rng.choice([".", "", "!"])) for t in range(3000)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"ok {t}.") for t in range(6)]
    want = brute(damaged(rows))
    assert answer(spark, frame(spark, rows), long_rows=500, stretch=128) == want
    assert answer(spark, frame(spark, rows)) == want


def test_repaired_rows_are_the_lines_of_the_digest(spark):
    rows = random_rows(5, 30)
    for how in ({}, {"long_rows": 2, "stretch": 3}):
        r = R.repair(R.damage(frame(spark, rows)), **how)
        lines = {}
        for x in sorted(r.rows().collect(), key=lambda x: x.place):
            lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
        for a in r.audits().collect():
            assert a.repaired_sha256 == hashlib.sha256("\n".join(lines.get(a.conv_id, [])).encode()).hexdigest()


def test_solver_against_recursion():
    rng = random.Random(1)
    for _ in range(1500):
        rows = tuple((rng.choice("suaut "), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(0, 14)))
        assert R.solve(rows) == cheapest(rows), rows
        cut = rng.randrange(0, len(rows) + 1)
        chain = R.Chain()
        for part in (rows[:cut], rows[cut:]):
            chain.add(R.solve(part, None))
        cost, pieces = chain.best()
        assert (cost, "".join(pieces)) == cheapest(rows)


def test_prefixes_order_like_strings_even_if_all_hashes_collide():
    rng = random.Random(2)
    for collide in (False, True):
        p = R.Prefixes()
        nodes = [0]
        for _ in range(400):
            nodes.append(p.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
            if collide:
                p.hash[-1] = 0
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert p.less(a, b) == (p.text(a) < p.text(b))


def test_empty_table(spark):
    r = R.repair(R.damage(frame(spark, [])))
    assert r.audits().collect() == [] and r.rows().collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "w " * 3_000_000 + "."), (1, 1, "assistant", "x" * 5_000_000 + "! " + " " * 100_000)]
    assert answer(spark, frame(spark, rows)) == brute(damaged(rows))
    assert answer(spark, frame(spark, rows), long_chars=10) == brute(damaged(rows))


def test_query_over_the_whole_table(spark):
    t = pd.read_parquet(f"{SF_SMALL}/conversations.parquet")
    rows = list(zip(t.conv_id.tolist(), t.turn.tolist(), t.role.tolist(), t.text.tolist()))
    q = QUERIES["op13_conversation_repair"](spark, SF_SMALL)
    assert sorted(repr(tuple(r)) for r in q.collect()) == brute(damaged(rows))
