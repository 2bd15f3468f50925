"""Derived inputs for the registered queries, built from the driver's tables.

Everything here is a deterministic function of the stored tables (integer
arithmetic only), so the Spark job and the SQL oracle see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)`` with ``label = toxic``."""
    from corpusflow.operators.labels import labelled_documents
    return labelled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions on the labelled rows (synthetic, integer rules),
    with the failure sentinel ``(-1, 0.0)`` on model A for ``doc_id % 97 = 0``."""
    lab = table(spark, sf_dir, "labels")
    d, t = F.col("doc_id"), F.col("toxic")
    pred_a = F.when((d * 7) % 10 < 7, t).otherwise(1 - t)
    pred_b = F.when((d * 13) % 10 < 9, t).otherwise(1 - t)
    conf_a = F.lit(0.5) + ((d * 31) % 50) / F.lit(100.0)
    conf_b = F.lit(0.5) + ((d * 17) % 50) / F.lit(100.0)
    sentinel = d % 97 == 0
    return lab.select(
        "doc_id", t.cast("int").alias("label"),
        F.when(sentinel, F.lit(-1)).otherwise(pred_a).cast("int").alias("pred_a"),
        F.when(sentinel, F.lit(0.0)).otherwise(conf_a).cast("double").alias("conf_a"),
        pred_b.cast("int").alias("pred_b"), conf_b.cast("double").alias("conf_b"),
        (d % 5).cast("int").alias("run"))


PREDICTIONS_SQL = """
SELECT doc_id, CAST(toxic AS INTEGER) AS label,
       CAST(CASE WHEN doc_id % 97 = 0 THEN -1
                 WHEN (doc_id * 7) % 10 < 7 THEN toxic ELSE 1 - toxic END AS INTEGER) AS pred_a,
       CAST(CASE WHEN doc_id % 97 = 0 THEN 0.0
                 ELSE 0.5 + ((doc_id * 31) % 50) / 100.0 END AS DOUBLE) AS conf_a,
       CAST(CASE WHEN (doc_id * 13) % 10 < 9 THEN toxic ELSE 1 - toxic END AS INTEGER) AS pred_b,
       CAST(0.5 + ((doc_id * 17) % 50) / 100.0 AS DOUBLE) AS conf_b,
       CAST(doc_id % 5 AS INTEGER) AS run
FROM labels
"""


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a training step log: run = user_id, step = event_id,
    epoch = day of ``ts``, loss = value, tokens = length of the props JSON; evaluation columns are set
    on ``view`` events only (the wide, sparse trainer log)."""
    ev = table(spark, sf_dir, "events")
    is_eval = F.col("event_type") == "view"
    v = F.col("value").cast("double")
    return ev.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"),
        F.datediff(F.to_date(F.col("ts")), F.to_date(F.lit("1970-01-01"))).cast("bigint").alias("epoch"),
        F.when(~is_eval, v).alias("loss"),
        F.length("props").cast("bigint").alias("n_tokens"),
        F.when(is_eval, v).alias("eval_loss"),
        F.when(is_eval, v / 100.0).alias("eval_accuracy"),
        F.when(is_eval, v / 200.0).alias("eval_f1"),
        F.when(is_eval, v / 300.0).alias("eval_precision"),
        F.when(is_eval, v / 400.0).alias("eval_recall"))


STEP_LOG_SQL = """
SELECT user_id AS run, event_id AS step,
       CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
       CASE WHEN event_type <> 'view' THEN value END AS loss,
       CAST(length(props) AS BIGINT) AS n_tokens,
       CASE WHEN event_type = 'view' THEN value END AS eval_loss,
       CASE WHEN event_type = 'view' THEN value / 100.0 END AS eval_accuracy,
       CASE WHEN event_type = 'view' THEN value / 200.0 END AS eval_f1,
       CASE WHEN event_type = 'view' THEN value / 300.0 END AS eval_precision,
       CASE WHEN event_type = 'view' THEN value / 400.0 END AS eval_recall
FROM events
"""
