"""Small literal frames with answers worked out by hand."""
import datetime as dt
from decimal import Decimal

from tijara.operators import ingest as IN
from tijara.operators import timeseries as TS
from tijara.operators import journey as JO


def test_funnel_needs_order(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "click", t(1)), (1, "view", t(2)), (1, "click", t(3)),  # click after the view counts
            (2, "view", t(1)), (2, "signup", t(2)), (2, "click", t(3)),  # no signup after the click
            (3, "click", t(1)), (4, "view", t(5)), (4, "click", t(5)), (4, "signup", t(6)), (4, "purchase", t(4)), (4, "purchase", t(9)),
            (None, "view", t(1))]
    ev = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz")
    assert {r.step: r.users for r in JO.funnel(ev).collect()} == {"view": 3, "click": 3, "signup": 1, "purchase": 1}


def _orders(spark, rows):
    return spark.createDataFrame([(d, Decimal(a)) for d, a in rows], "order_date date, order_total_amount decimal(12,2)")


def test_range_does_not_make_a_month_partial(spark):
    o = _orders(spark, [(dt.date(1998, 12, 10), 5), (dt.date(1999, 5, 20), 7)])
    got = TS.revenue_trend(o, "monthly", "1998-01-01", "1998-12-31").collect()
    assert [(r.period, r.is_partial) for r in got] == [(dt.date(1998, 12, 1), False)]
    full = {r.period: r.is_partial for r in TS.revenue_trend(o, "monthly").collect()}
    assert full == {dt.date(1998, 12, 1): False, dt.date(1999, 5, 1): True}


def test_upsert_sees_moved_nulls_and_repeated_keys(spark):
    s = spark.createDataFrame([(1, "x", None), (2, "a", "b"), (3, "k", "k")], "id int, p string, q string")
    b = spark.createDataFrame([(1, None, "x"), (2, "a", "b"), (4, "n", None), (4, "m", None), (None, "z", None), (None, "z", None)],
                              "id int, p string, q string")
    got = sorted((str(r.id), r.action) for r in IN.classify_upsert(s, b, "id", ["p", "q"]).collect())
    assert got == [("1", "updated"), ("2", "unchanged"), ("3", "stored_only"), ("4", "inserted"), ("4", "rejected"),
                   ("None", "rejected"), ("None", "rejected")]
    snap = IN.apply_upsert(s, b, "id")
    assert sorted(tuple(r) for r in snap.collect()) == [(1, None, "x"), (2, "a", "b"), (3, "k", "k"), (4, "m", None)]
    again = IN.classify_upsert(snap, IN.accepted(b, "id"), "id", ["p", "q"])
    assert {r.action for r in again.filter("id <> 3").collect()} == {"unchanged"}
