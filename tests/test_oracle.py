"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), and the flagship entry at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"
SLOW = {"multi_seed_runs", "text_classifier", "score_table"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - SLOW))
def test_query_matches_oracle(spark, con, name):
    ok, nrows, _, detail = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con)
    assert ok, detail


def test_classifier_metrics_belong_to_their_splits(spark):
    """The model queries, which SQL cannot express: row sets, ranges, and each
    prediction the larger of two probabilities."""
    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = E.queries()["score_table"](spark, sf).collect()
    assert {r["doc_id"]: r["label"] for r in scored} == labels and len(scored) == len(labels)
    assert all(r["pred"] in (0, 1) and 0.5 <= r["conf"] <= 1 for r in scored)
    assert sum(r["pred"] == r["label"] for r in scored) > 0.8 * len(scored)
    runs = E.queries()["multi_seed_runs"](spark, sf).collect()
    assert {r["split"] for r in runs} == {"validation", "test"} and all(r["n_runs"] == 5 for r in runs)
    shares = [r for r in runs if r["metric"] in ("accuracy", "precision", "recall", "f1")]
    assert shares and all(0 <= r["mean"] <= 1 and 0 <= r["std"] <= 0.5 for r in shares)
