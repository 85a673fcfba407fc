"""The pipeline stage by stage over a small table; and the chat answer in SQL."""

import pytest

import corpus_pipeline
from checks.compare import connect, difference
from tests.conftest import TESTDATA
from zoneflow.llm import queries
from zoneflow.llm.common import stored

SF = f"{TESTDATA}/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id: r.text for r in rows}
        assert len(kept[name]) == len(rows) and kept[name].keys() <= before.keys()
        assert all(r.n_chars == len(r.text) for r in rows)
    good = [i for i in kept["quality"] if i in labels]
    assert sum(labels[i].quality for i in good) >= 0.98 * len(good)
    calm = [i for i in kept["toxicity"] if i in labels]
    assert sum(labels[i].toxic for i in calm) <= 0.06 * len(calm)
    texts = [" ".join(t.split()) for t in kept["near_duplicates"].values() if t.split()]
    assert len(set(texts)) == len(texts)
    lost = {" ".join(t.split()) for t in kept["toxicity"].values()} - set(texts)
    assert len(kept["near_duplicates"]) > 0.8 * len(kept["toxicity"]) and len(lost) < 0.1 * len(texts)
    assert kept["secrets"].keys() == kept["near_duplicates"].keys()
    assert not any("token = \"0" in t for t in kept["secrets"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept["secrets"].keys()
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


@pytest.mark.parametrize("name", queries.ORACLE)
def test_answers_in_sql(spark, name):
    con = connect(SF)
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) is None
