"""Writers (I4-I7; the vocabulary round trip I8 lives with the vocabulary)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.arrays import by_slices


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """I4: CSV with header, quotes escaped by doubling, one folder per split."""
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; every column kept, non-ASCII text written as is."""
    df.write.mode("overwrite").json(path)


def _rewritten(source: str, text: str | None) -> str:
    return json.dumps(json.loads(source) | {"text": text}, ensure_ascii=False)


@F.arrow_udf(T.StringType())
def rewrite_source(source: pa.Array, text: pa.Array) -> pa.Array:
    """Objects that VARIANT cannot hold (NaN, infinities), with ``text`` replaced."""
    return by_slices(lambda s, t: pa.array([None if a is None else _rewritten(a, b) for a, b in zip(s.to_pylist(), t.to_pylist())],
                                           pa.string()), source, text)


def write_variant_jsonl(df: DataFrame, path: str, data: str = "data", text: str = "text", source: str = "source") -> None:
    """I5 for open-schema documents (A2): the original object with ``text``
    replaced in its place, or added; unknown keys preserved.  Rows with a
    ``source`` (if there is such a column) are rewritten from that."""
    fields = F.from_json(F.to_json(F.col(data)), "map<string,variant>")
    new = F.col(text).cast("variant")
    patched = F.when(F.map_contains_key(fields, "text"),
                     F.transform_values(fields, lambda k, v: F.when(k == "text", new).otherwise(v))) \
        .otherwise(F.map_concat(fields, F.create_map(F.lit("text"), new)))
    lines = df.withColumn("_line", F.to_json(patched, {"ignoreNullFields": "false"}))
    if source in df.columns:
        plain = lines.where(F.col(source).isNull()).select(F.col("_line").alias("value"))
        lines = plain.unionByName(df.where(F.col(source).isNotNull()).select(rewrite_source(source, text).alias("value")))
    else:
        lines = lines.select(F.col("_line").alias("value"))
    lines.write.mode("overwrite").text(path)


def write_text(df: DataFrame, path: str, col: str = "text") -> None:
    """One text per line."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small driver-side report (counts, decisions) as one JSON document."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def report_row(df: DataFrame) -> DataFrame:
    """I7 for a one-row aggregate: the row as a JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
