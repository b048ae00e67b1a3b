"""The pipeline stage by stage, each against what its operator should decide."""
import random
import re

import pandas as pd
import pytest

import corpus_pipeline as C
from tests.llm.conftest import docs_of
from tests.llm.test_llm_exact_dedup import norm
from tests.llm.test_llm_mixing import size, water
from tests.llm.test_llm_packing import ids_of
from tests.llm.test_llm_simhash import brute, fingerprint
from tijara.llm import toxicity as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(SF + "/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(where / str(i)))
        docs = spark.read.parquet(str(where / str(i)))
        out.append(docs.toPandas())
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "best-fit packing"]
    columns = spark.read.parquet(SF + "/documents.parquet").columns
    assert all(list(s.columns) == columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages, documents):
    docs = spark.read.parquet(SF + "/documents.parquet")
    model = T.fit(docs, spark.read.parquet(SF + "/labels.parquet"))
    score = dict(zip(documents.doc_id, (p for p, _ in model.score(documents.text))))
    assert sorted(stages[0].doc_id) == sorted(i for i, s in score.items() if s < 0.5)
    labels = pd.read_parquet(SF + "/labels.parquet")
    clean = labels[labels.toxic == 0].doc_id
    assert clean.isin(stages[0].doc_id).mean() > 0.97


def test_copies_go(stages):
    before, after = stages[0], stages[1]
    first = before.assign(t=before.text.map(norm)).groupby("t").doc_id.min()
    assert sorted(after.doc_id) == sorted(first)
    comp = brute(list(after.doc_id), [fingerprint(t) for t in after.text])
    assert sorted(stages[2].doc_id) == sorted(set(comp))


def test_mix(stages):
    before, after = stages[2], stages[3]
    sizes = before.assign(n=before.text.map(size)).groupby("source").n.sum().to_dict()
    taken = after.assign(n=after.text.map(size)).groupby("source").n.sum().to_dict()
    longest = before.text.map(size).max()
    assert all(abs(taken.get(s, 0) - t) <= longest / 2 + 1e-6 for s, t in water(sizes).items())
    text = dict(zip(before.doc_id, before.text))
    assert all(text[i] == t for i, t in zip(after.doc_id, after.text))
    assert after.groupby("doc_id").size().max() <= 2


def test_packed(stages):
    want = {}
    for d, t in zip(stages[3].doc_id, stages[3].text):
        want[d] = want.get(d, 0) + len(ids_of(t))
    got = stages[4]
    assert got.groupby("doc_id").length.sum().to_dict() == want
    full = got.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and len(full) <= -(-sum(want.values()) // 2048) + 2
    run = got.sort_values(["sequence_id", "offset"])
    assert (run.offset == run.groupby("sequence_id").length.cumsum() - run.length).all()


def test_run_gives_the_last_stage(spark, stages):
    out = C.run(spark, SF).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out[cols].values.tolist())) == sorted(map(tuple, stages[4][cols].values.tolist()))


def test_odd_rows(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 30))), r.choice(["x", "y", None])) for i in range(40)]
    rows += [(1, None, "x"), (None, "some words here", None), (2, "", "y"), (3, "long " * 40_000, "x"), (3, "long " * 40_000, "x")]
    docs = docs_of(spark, rows, ("uid", "key", "position"))
    spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        df = start
        for i, (name, stage) in enumerate(C.STAGES):
            path = str(tmp_path / f"{start is docs}-{i}")
            stage(spark, df, str(tmp_path)).write.parquet(path)
            df = spark.read.parquet(path)
            if i < 4:
                assert df.columns == docs.columns
        assert (df.count() > 0) == (start is docs)
    assert re.match("best", C.STAGES[-1][0])
