"""Every text query with SQL against that SQL, and the pipeline, over the smallest tables."""

import pytest

from cohortis.llm import queries as texts
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(texts.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, texts.QUERIES[name], texts.ORACLES[name]) is None


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    for n in range(1, 14):
        assert [q for q in entry.queries() if q.startswith(f"op{n}_")]
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == first.columns, name
        docs = spark.createDataFrame(out.collect(), first.schema)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    rows = c.run(spark, FOLDER).select("doc_id", "epoch").collect()
    assert {r[0] for r in rows} <= ids and len(rows) == len(set(rows)) > 0
