"""User journeys in one pass: conversion funnel and step-to-step transitions.

Events are range-sorted by (user, time, step), so a user with a third of all
events is many tasks' work.  A task goes through its rows batch by batch; all
users that lie inside a batch are followed together.  Of the first and the last
user of a batch it emits a *fragment*: for every number of steps that the user
may have reached before, how far the fragment takes them (an automaton's
transition function, which can be composed), and its first and last event.
Fragments of a user, at most two a batch, are composed in order.  Everything
else leaves a task as sums.

A step is reached at the first event of its kind at or after the time the step
before was reached.  Rows of one time are in the order of the steps, so that
steps at one time are all reached, whatever rows a border parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared

STEPS = ("view", "click", "signup", "purchase")
_NEVER = np.iinfo(np.int64).max

_OUT = ("kind string, a int, b int, n long, gap long, user long, task int, batch int, reach array<int>, "
        "first_step int, first_at long, last_step int, last_at long")


def reached(step: np.ndarray, at: np.ndarray, user: np.ndarray, users: int, k: int, begin: int) -> np.ndarray:
    """Steps reached by every user (0 .. users - 1) that had reached ``begin`` before."""
    before = np.full(users, np.iinfo(np.int64).min)
    done = np.full(users, begin)
    for s in range(begin, k):
        rows = np.flatnonzero((step == s) & (at >= before[user]))
        now = np.full(users, _NEVER)
        np.minimum.at(now, user[rows], at[rows])
        got = (now != _NEVER) & (done == s)
        done[got] = s + 1
        before = np.where(got, now, _NEVER)
    return done


def _row(kind: str, **values) -> dict:
    return {"kind": kind, "a": None, "b": None, "n": None, "gap": None, "user": None, "task": None, "batch": None, "reach": None,
            "first_step": None, "first_at": None, "last_step": None, "last_at": None, **values}


def _follow(k: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        steps = np.zeros(k + 1, np.int64)  # users by steps reached
        pairs, gaps = np.zeros(k * k, np.int64), np.zeros(k * k, np.int64)
        rows = []
        for number, b in enumerate(batches):
            if not b.num_rows:
                continue
            ids, at, step = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.concatenate(([True], ids[1:] != ids[:-1]))
            user = np.cumsum(new) - 1
            n = int(user[-1]) + 1
            same = np.flatnonzero(~new)
            code = step[same - 1].astype(np.int64) * k + step[same]
            pairs += np.bincount(code, minlength=k * k)
            np.add.at(gaps, code, at[same] - at[same - 1])
            begin = np.append(np.flatnonzero(new), len(ids))
            rim = {0, n - 1}
            done = reached(step, at, user, n, k, 0)
            inner = np.ones(n, bool)
            inner[list(rim)] = False
            steps += np.bincount(done[inner], minlength=k + 1)
            for u in sorted(rim):
                i, j = int(begin[u]), int(begin[u + 1])
                part = np.zeros(j - i, np.int64)
                reach = [int(done[u])] + [int(reached(step[i:j], at[i:j], part, 1, k, e)[0]) for e in range(1, k)] + [k]
                rows.append(_row("part", user=int(ids[i]), task=task, batch=number, reach=reach, first_step=int(step[i]), first_at=int(at[i]),
                                 last_step=int(step[j - 1]), last_at=int(at[j - 1])))
            if len(rows) >= 1000:
                yield _batch(pa, rows)
                rows = []
        rows += [_row("users", a=int(s), n=int(c)) for s, c in enumerate(steps) if c]
        rows += [_row("pair", a=i // k, b=i % k, n=int(c), gap=int(gaps[i])) for i, c in enumerate(pairs) if c]
        if rows:
            yield _batch(pa, rows)
    return run


def _batch(pa, rows):
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.split()[0], types[f.split()[1]]) for f in _OUT.split(", ")]))


def _compose(parts: pd.DataFrame) -> pd.DataFrame:
    """Fragments of one user -> its steps reached, and the transitions between fragments."""
    parts = parts.sort_values(["task", "batch"])
    state, rows, last = 0, [], None
    for p in parts.itertuples():
        state = int(p.reach[state])
        if last is not None:
            rows.append(("pair", last[0], p.first_step, 1, p.first_at - last[1]))
        last = p.last_step, p.last_at
    rows.append(("users", state, None, 1, None))
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "gap"]).astype({"a": "Int32", "b": "Int32", "n": "Int64", "gap": "Int64"})


def journeys(events: DataFrame, steps=STEPS) -> DataFrame:
    """kind ('users': a = steps reached; 'pair': a to b), n, gap (microseconds, summed), in a written table."""
    step = F.lit(None).cast("int")
    for i, s in enumerate(steps):
        step = F.when(F.col("event_type") == s, i).otherwise(step)
    e = events.select(F.col("user_id").cast("long").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), step.alias("step"))
    e = e.filter("user is not null and at is not null and step is not null")
    e = e.repartitionByRange("user", "at", "step").sortWithinPartitions("user", "at", "step")
    out = write_shared(e.mapInArrow(_follow(len(steps)), _OUT), "journeys")
    cut = out.filter("kind = 'part'").groupBy("user").applyInPandas(_compose, "kind string, a int, b int, n long, gap long")
    return out.filter("kind <> 'part'").select("kind", "a", "b", "n", "gap").unionByName(cut)


def funnel(events: DataFrame, steps=STEPS) -> DataFrame:
    """Declared (△) conversion funnel: users that reach each step in order."""
    names = F.array(*[F.lit(s) for s in steps])
    g = journeys(events, steps).filter("kind = 'users'").agg(*[F.coalesce(F.sum(F.when(F.col("a") > i, F.col("n"))), F.lit(0)).alias(f"s{i}") for i in range(len(steps))])
    return g.select(F.explode(F.arrays_zip(names.alias("step"), F.array(*[f"s{i}" for i in range(len(steps))]).alias("users"))).alias("x")).select("x.step", "x.users")


def transitions(events: DataFrame, steps=STEPS) -> DataFrame:
    """Declared (△) journey view: how often one step follows another as a user's next event, the share of the moves from
    that step, and the mean time between them."""
    names = F.array(*[F.lit(s) for s in steps])
    p = journeys(events, steps).filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("transitions"), F.sum("gap").alias("gap"))
    out = p.groupBy("a").agg(F.sum("transitions").alias("all")).withColumnRenamed("a", "from")
    t = F.col("transitions").cast("double")
    return p.join(out, F.col("a") == F.col("from")).select(
        F.get(names, F.col("a")).alias("from_step"), F.get(names, F.col("b")).alias("to_step"), "transitions",
        (t / F.col("all").cast("double")).alias("share"), (F.col("gap").cast("double") / t / 1e6).alias("mean_gap_sec"))
