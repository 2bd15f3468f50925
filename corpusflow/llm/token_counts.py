"""Token counts from an exact length histogram.

Documents are encoded once and counted by encoded length; from the histogram,
whose size is the number of distinct lengths, suffix sums answer totals,
quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusflow.llm.common import give_back, read_bytes, row_slices, table, tokenizer_path
from corpusflow.llm.word_tokens import tokenizer_of
from corpusflow.session import materialize

_SLICE_BYTES = 4 << 20            # text in work at a time
_BUCKET = 4096                    # lengths whose suffix sums are taken together


def token_counter(spark, tokenizer: str | None = None):
    """A column function text -> number of ids (0 for null)."""
    data = spark.sparkContext.broadcast(read_bytes(tokenizer or tokenizer_path("word_bpe_49k.json")))

    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = tokenizer_of(data.value)
        for column in texts:
            n = [tok.encode_column(column.slice(a, b - a))[1] for a, b in row_slices(column, _SLICE_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *n]))
        give_back()

    return F.arrow_udf(count, T.LongType())


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(length, n_docs)``: how many rows of ``docs`` have each encoded length.
    Every row counts, repeated ones too; a null text has length 0."""
    n = token_counter(docs.sparkSession, tokenizer)(F.col("text").cast("string"))
    return docs.select(n.alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per distinct length: ``n_docs, n_tokens`` of the documents of that
    length, ``docs_from, tokens_from`` of all at least as long, ``docs_to``,
    ``tokens_to`` of all at most as long, and ``truncated_tokens``: the total if
    every document is cut to that length.  Sums run within buckets of lengths
    and over the buckets, so no task sees all lengths.  The histogram is read
    twice, so it is written first: each text is encoded once."""
    h = materialize(histogram, "length-histogram").withColumn("n_tokens", F.col("length") * F.col("n_docs")) \
                 .withColumn("bucket", F.floor(F.col("length") / _BUCKET))
    total = lambda name, w: F.coalesce(F.sum(name).over(w), F.lit(0))
    later = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    b = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    b = b.select("bucket", total("d", later).alias("d_after"), total("t", later).alias("t_after"),
                 total("d", earlier).alias("d_before"), total("t", earlier).alias("t_before"))
    down = W.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)
    up = W.partitionBy("bucket").orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = h.join(b, "bucket").select(
        "length", "n_docs", "n_tokens",
        (F.col("d_after") + F.sum("n_docs").over(down)).alias("docs_from"),
        (F.col("t_after") + F.sum("n_tokens").over(down)).alias("tokens_from"),
        (F.col("d_before") + F.sum("n_docs").over(up)).alias("docs_to"),
        (F.col("t_before") + F.sum("n_tokens").over(up)).alias("tokens_to"))
    return s.withColumn("truncated_tokens",
                        F.col("tokens_to") + F.col("length") * (F.col("docs_from") - F.col("n_docs")))


def truncated_total(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """``(limit, truncated_tokens)`` for any limits (a caller's short table
    ``limit``, 0 or more): the total if every document is cut to ``limit``."""
    limits = limits.select(F.col("limit").cast("long").alias("limit")).distinct()
    per = sums.select("length", "n_docs", "n_tokens").join(F.broadcast(limits))
    return per.groupBy("limit").agg(F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """``(length)``: the smallest length that a share ``q`` of all documents
    does not exceed (no row for an empty table)."""
    reached = F.col("docs_to") >= F.lit(q) * (F.col("docs_to") - F.col("n_docs") + F.col("docs_from"))
    return sums.where(reached).agg(F.min("length").alias("length")).where(F.col("length").isNotNull())


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
