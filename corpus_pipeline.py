"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and rereads it as the next stage's
``docs``.  All stages but the last return the columns of ``documents``; a stage
works on every row that the one before it kept.

1. ``language_id``: documents whose language is ``und`` (null text, or no
   letter) go.
2. ``line_dedup``: lines found in five documents or more go, except from the
   last document that holds them.
3. ``near_dedup``: one document of each near-duplicate group (five-word
   shingles, similarity 0.8) stays.
4. ``decontaminate``: documents of which a twentieth of the words or more lies in
   13-word passages of ``benchmark`` go.
5. ``encode``: piece ids of each text, decoded again to prove the round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import common, decontam, langid, line_dedup, near_dup, piece_codec
from corpusflow.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.train_on_documents(docs))
    return found.where(F.col("found.lang_pred") != langid.UNKNOWN).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.select(F.col("row").withField("text", F.col("kept.text")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(docs).select("doc_id", "ids", "n_tokens", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: learning, signatures and Viterbi are beyond SQL: tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
