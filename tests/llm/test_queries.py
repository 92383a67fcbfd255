import pytest

import corpus_pipeline
from quillspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, name):
    same(spark, con, SF, QUERIES[name], ORACLES[name])


def test_eleven_queries():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_pipeline(spark, con):
    same(spark, con, SF, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_carry_odd_columns_and_rows(spark):
    rows = [(1, "a cat", "en"), (2, "A CAT", "en"), (2, "A CAT", "en"), (3, None, None), (4, "", "en"), (5, "1 2", None), (6, "the dog " * 4000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS source", "7 AS score", "true AS contaminated", "1 AS keep_id", "2 AS component_id", "'z' AS lang_pred")
    kept = [{1, 2, 6}, None, None, {1, 2, 3, 4, 5, 6}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], kept, strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all((r.score, r.contaminated, r.keep_id, r.component_id, r.lang_pred) == (7, True, 1, 2, "z") for r in found), name
        if ids is not None:
            assert {r.doc_id for r in found} == ids, name
    exact = [r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect()]
    assert sorted(exact) == [2, 4, 5, 6]
    near = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert near == {1, 3, 4, 5, 6}
