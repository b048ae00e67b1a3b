"""Cleaning actions observed on the way: same numbers, no second read."""
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tijara.operators import cleaning as CL
from tijara.plans import canonical as K


def test_observed_counts_are_those_of_queries(spark):
    c = K.canon(spark, SF_SMALL)
    raw, cat = c.get("raw_transactions"), c.get("raw_catalogue")
    clean, actions = CL.clean_with_actions(raw, cat)
    got = {r.code: (r.affected_rows, r.affected_cells) for r in actions.collect()}
    want = raw.agg(*CL._raw_metrics()).first()
    assert got["money_text"] == (want.money_rows, want.money_cells) and got["payment_labels"][0] == want.payments > 0
    assert got["duplicates_removed"][0] == raw.count() - raw.distinct().count() > 0
    plain = CL.clean_transactions(raw, cat)
    assert clean.exceptAll(plain).count() == 0 and plain.exceptAll(clean).count() == 0
    assert raw.count() - got["duplicates_removed"][0] - got["incomplete_removed"][0] == clean.count()


def test_one_scan_of_the_export(spark, monkeypatch):
    seen = []
    real = CL.write_shared
    monkeypatch.setattr(CL, "write_shared", lambda df, label: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    c = K.canon(spark, SF_SMALL)
    CL.clean_with_actions(c.get("raw_transactions"))
    plan = seen[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("CollectMetrics") >= 2
