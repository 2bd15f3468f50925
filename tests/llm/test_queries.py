"""The registered queries against their SQL, and the pipeline stage by stage."""


import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from corpusflow.llm import near_dup, queries
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_operator_is_registered():
    names = list(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    ok, _, _, detail = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert ok, detail


def test_pipeline_stages(spark):
    sf001 = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "42", "en", "s", 2)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf001).cache()
        if name != "encode":
            assert now.columns == docs.columns
        gone = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in now.select("doc_id").collect()}
        if name == "language_id":
            assert gone == {10 ** 6, 10 ** 6 + 1}
        if name == "line_dedup":
            assert not gone
        if name == "near_dedup":
            sets = [near_dup.shingle_set(r.text.encode(), 5) for r in now.select("text").collect()]
            for i, x in enumerate(sets):
                for y in sets[:i]:
                    both = len(np.intersect1d(x, y))
                    assert not both or 100 * both < 80 * (len(x) + len(y) - both)
        if name == "encode":
            assert not gone and now.where("not round_trip").count() == 0
