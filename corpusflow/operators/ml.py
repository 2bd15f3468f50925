"""Modelling re-aimed at Spark ML (J1, J2, J5) and vector pooling.

The reference trains neural models by gradient descent on one GPU; here the
classifier is a ``pyspark.ml`` pipeline (tokenise -> hashed term frequencies
-> IDF -> logistic regression), trained and scored as distributed jobs, and
evaluated with the same metric operators (E5 / E6)."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrays import argmax, confidence
from corpusflow.operators import metrics as M
from corpusflow.operators import sampling as S
from corpusflow.session import materialize

SEEDS_AT_ONCE = 5


def pool_vectors(df: DataFrame, group: str = "label", pos: str = "vec_id", vec: str = "embedding",
                 mask: str | None = "mask") -> DataFrame:
    """Per group and dimension — masked mean (denominator clamped to at
    least 1), plain mean, and the last vector by position.

    Long form ``(group, dim, masked_mean, mean, last)``: partial aggregation per
    ``(group, dim)``, so a group holding a third of all rows is pre-aggregated
    on every map task."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    ex = df.select(group, pos, m.alias("_m"), F.posexplode(vec).alias("dim", "_v"))
    ex = ex.withColumn("_v", F.col("_v").cast("double"))
    agg = ex.groupBy(group, "dim").agg(
        (F.sum(F.col("_v") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1.0))).alias("masked_mean"),
        F.avg("_v").alias("mean"),
        F.max_by("_v", pos).alias("last"))
    return agg


def classifier_pipeline(num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 50) -> Pipeline:
    """The text classifier as a Spark ML pipeline."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=max_iter,
                           probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ])


def with_terms(df: DataFrame, **kw) -> DataFrame:
    """The stages of :func:`classifier_pipeline` that learn nothing (words, hashed
    counts) applied to every row and stored as ``_tf`` instead of the text (null
    where the text is), so that fits and scores that read it again and again cut
    no text into words."""
    words, counts = classifier_pipeline(**kw).getStages()[:2]
    keep = [c for c in df.columns if c != "text"]
    whole = df.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("_there"))
    terms = counts.transform(words.transform(whole))
    return materialize(terms.select(*keep, F.when(F.col("_there"), F.col("_tf")).alias("_tf")), "terms")


def train_text_classifier(train: DataFrame, **kw) -> PipelineModel:
    """Fit on ``(text, label)`` rows, or on rows of :func:`with_terms` made with
    the same arguments (label cast to double for Spark ML)."""
    words, counts, idf, classifier = classifier_pipeline(**kw).getStages()
    data = train if "_tf" in train.columns else with_terms(train.select("text", "label"), **kw)
    data = data.where(F.col("_tf").isNotNull()).select(F.col("label").cast("double").alias("label"), "_tf")
    weights = idf.fit(data)
    return PipelineModel([words, counts, weights, classifier.fit(weights.transform(data))])


def score_table(model: PipelineModel, df: DataFrame, sentinel: int = -1) -> DataFrame:
    """Probabilities, prediction (argmax, first on ties) and confidence for
    every row; rows that cannot be scored (null text) get ``(-1, 0.0)``.  Rows of
    :func:`with_terms` are scored from their stored counts."""
    source, stages = ("_tf", model.stages[2:]) if "_tf" in df.columns else ("text", model.stages)
    keep = [c for c in df.columns if c != "_tf"]
    ok = df.where(F.col(source).isNotNull())
    bad = df.where(F.col(source).isNull())
    # stored: whatever reads the prediction, each row goes through the model once
    scored = PipelineModel(stages).transform(ok).select(*keep, vector_to_array("_prob").alias("probs"))
    scored = materialize(scored, "scored")
    scored = scored.withColumn("pred", argmax("probs")).withColumn("conf", confidence("probs", F.col("pred")))
    failed = bad.select(*keep, F.lit(None).cast("array<double>").alias("probs"),
                        F.lit(sentinel).alias("pred"), F.lit(0.0).alias("conf"))
    return scored.unionByName(failed)


def score_rows(df: DataFrame, make_model, text: str = "text", sentinel: int = -1, batch_rows: int = 256) -> DataFrame:
    """J2 for models that are no Spark ML pipelines: ``probs``, ``pred`` (argmax,
    first on ties) and ``conf`` for every row.

    ``make_model()`` is called once per task and returns a function from a list of
    texts to a matrix of probabilities (a row each).  Texts go through it in batches
    of ``batch_rows``; where a batch fails its rows are tried one by one, and a row
    that fails, gives values that are not finite, or has a null text gets
    ``(null, sentinel, 0.0)`` without hurting the others."""
    def failed():
        return None, sentinel, 0.0

    def judged(row) -> tuple:
        row = np.asarray(row, float)
        if row.ndim != 1 or not len(row) or not np.isfinite(row).all():
            return failed()
        best = int(row.argmax())
        return row.tolist(), best, float(row[best])

    def one_by_one(model, texts: list) -> list:
        out = []
        for t in texts:
            try:
                out.append(judged(model([t])[0]))
            except Exception:                    # one bad row must not cost the others
                out.append(failed())
        return out

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for column in columns:
            out = [failed()] * len(column)
            texts = column.to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(there), batch_rows):
                part = there[at:at + batch_rows]
                try:
                    rows = model([texts[i] for i in part])
                    if len(rows) != len(part):
                        raise ValueError("a model gives one row per text")
                    found = list(map(judged, rows))
                except Exception:
                    found = one_by_one(model, [texts[i] for i in part])
                for i, x in zip(part, found):
                    out[i] = x
            yield pa.array([dict(zip(("probs", "pred", "conf"), x)) for x in out], pa.struct(
                [("probs", pa.list_(pa.float64())), ("pred", pa.int32()), ("conf", pa.float64())]))

    scored = F.arrow_udf(score, "struct<probs: array<double>, pred: int, conf: double>")
    return df.withColumn("_s", scored(F.col(text).cast("string"))).select(*df.columns, "_s.probs", "_s.pred", "_s.conf")


def evaluate_splits(model: PipelineModel, splits: DataFrame, split: str = "split") -> DataFrame:
    """J1 held-out metrics: E5 per split of the scored table."""
    scored = score_table(model, splits)
    return M.binary_metrics(scored.where(F.col("pred") != -1), "label", "pred", [split])


def multi_seed_runs(labelled: DataFrame, seeds=(42, 43, 44, 45, 46), ratios=(0.8, 0.1, 0.1),
                    id_col: str = "doc_id", **kw) -> DataFrame:
    """Split / train / evaluate per seed (each iteration a distributed
    fit), metrics in long form ``(run, split, metric, value)`` for E9.

    All seeds read one stored table of hashed counts.  Their fits run side by side
    (``SEEDS_AT_ONCE``): an iteration is a short job that alone leaves cores idle."""
    terms = with_terms(S.with_row_hash(labelled), **kw)

    def run(seed):
        sp = S.split3(terms, ratios, seed=seed, id_col=id_col)
        model = train_text_classifier(sp.where(F.col("split") == "train"), **kw)
        m = evaluate_splits(model, sp.where(F.col("split") != "train"))
        return M.unpivot_metrics(m.withColumn("run", F.lit(seed)), ["run", "split"])

    with ThreadPool(min(SEEDS_AT_ONCE, len(seeds))) as pool:
        runs = pool.map(inheritable_thread_target(labelled.sparkSession)(run), seeds)
    return S.union_all(*runs)
