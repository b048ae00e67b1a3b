import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=()):
    """A documents frame from (doc_id, text[, source]) rows, over several
    partitions, with extra columns whose names clash with working columns."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    for name in extra:
        df = df.withColumn(name, df.doc_id.cast("string"))
    return df.repartition(3) if rows else df


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    from tijara.llm.common import prepare
    prepare(spark)


CLASH = ("uid", "key", "digest", "h", "tie", "size", "m", "fp", "_c0", "keep_id", "kept", "position", "new", "dk")
