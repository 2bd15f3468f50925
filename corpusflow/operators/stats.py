"""Dataset profiling.

Per split and for all splits together ("combined"): rows, class counts and
percentages, mean and exact median text length.  The split rows and the
combined row come from one GROUPING SETS aggregate; the median is recomputed
for the combined row, not averaged.  ``median`` keeps a value->count map per
group, so its state is bounded by the number of distinct lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMBINED = "combined"


def dataset_stats(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """E1 + E2: ``(split, total_rows, avg_text_length, median_text_length)``."""
    length = F.length(F.col(text)).cast("double")
    g = (df.withColumn("_len", length)
         .rollup(split)
         .agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"),
              F.avg("_len").alias("avg_text_length"),
              F.median("_len").alias("median_text_length"),
              F.grouping_id().alias("_gid")))
    return g.select(F.when(F.col("_gid") == 1, F.lit(COMBINED)).otherwise(F.col(split)).alias("split"),
                    "total_rows",
                    F.coalesce("avg_text_length", F.lit(0.0)).alias("avg_text_length"),
                    F.coalesce("median_text_length", F.lit(0.0)).alias("median_text_length"))


def class_breakdown(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """``(split, label, class_count, class_pct)``; null labels are not
    counted as a class but do count in the split's total (pandas)."""
    g = (df.groupingSets([[split, label], [label]], split, label)
         .agg(F.count(F.lit(1)).cast("bigint").alias("class_count"), F.grouping_id().alias("_gid")))
    g = g.select(F.when(F.col("_gid") == 2, F.lit(COMBINED)).otherwise(F.col(split)).alias("split"),
                 label, "class_count")
    totals = (df.rollup(split).agg(F.count(F.lit(1)).alias("_total"), F.grouping_id().alias("_gid"))
              .select(F.when(F.col("_gid") == 1, F.lit(COMBINED)).otherwise(F.col(split)).alias("split"),
                      "_total"))
    return (g.where(F.col(label).isNotNull())
            .join(F.broadcast(totals), "split")
            .select("split", F.col(label).alias("label"), "class_count",
                    (F.col("class_count") / F.col("_total") * 100.0).alias("class_pct")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, nulls excluded, ordered by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(col))


def n_unique(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values."""
    return df.agg(F.count_distinct(F.col(col)).cast("bigint").alias("n_unique"))


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def split_breakdown(df: DataFrame, split: str = "split") -> DataFrame:
    """``split_breakdown`` — rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"))
