"""The classifier's stored counts: texts are cut once, results are those of whole texts."""

import pytest
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from corpusflow.operators import ml, sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(
        F.lit("w"), (F.hash("id", i) % 9).cast("string"))), " ")
    # some ids and rows repeat, some texts are null or empty
    return spark.range(300).select((F.col("id") % 280).alias("doc_id"), F.when(F.col("id") % 41 == 0, None).when(
        F.col("id") % 43 == 0, "").otherwise(F.concat_ws(" ", words, F.when(F.col("id") % 2 == 0, "bad"))).alias("text"),
        (F.col("id") % 2 == 0).cast("int").alias("label"))


@pytest.fixture
def cuts(monkeypatch):
    seen = []
    transform = RegexTokenizer._transform
    monkeypatch.setattr(RegexTokenizer, "_transform", lambda self, df: (seen.append(1), transform(self, df))[1])
    return seen


def test_all_seeds_cut_the_texts_once(rows, cuts):
    got = ml.multi_seed_runs(rows, seeds=(1, 2), ratios=(0.6, 0.2, 0.2), num_features=64, max_iter=3).collect()
    assert len(cuts) == 1
    want = []
    for seed in (1, 2):
        sp = S.split3(rows, (0.6, 0.2, 0.2), seed=seed)
        model = ml.train_text_classifier(sp.where("split = 'train'"), num_features=64, max_iter=3)
        m = ml.evaluate_splits(model, sp.where("split <> 'train'"))
        want += ml.M.unpivot_metrics(m.withColumn("run", F.lit(seed)), ["run", "split"]).collect()
    key = lambda r: (r["run"], r["split"], r["metric"], round(r["value"], 9))
    assert got and sorted(map(key, got)) == sorted(map(key, want))
