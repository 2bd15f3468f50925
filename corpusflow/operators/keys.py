"""Order keys, dense global positions and prefix sums without a single partition.

Spark rows have no order, so every order-sensitive operator takes an explicit
order key.  A global position (0..n-1) or a running total in that order is
computed in two levels:

1. every row gets a coarse *bucket* that is monotone in the order key
   (equal-count quantile ranges of a numeric key — :func:`with_quantile_bucket`
   — or a hex prefix of an md5 key, which is uniform by construction);
2. per-bucket counts / sums are aggregated (partial aggregation, tiny result),
   turned into offsets by a window over the bucket table only (bounded by the
   number of buckets), broadcast back, and added to a rank / running sum that
   is computed inside each bucket with ``Window.partitionBy(bucket)``.

No data-sized window ever runs without ``partitionBy``; what is broadcast is
the offset table whose size is the bucket count (a parameter), not the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialize

DEFAULT_BUCKETS = 1024
HOT_SHARE = 1000                  # keys with more than this part of all rows are joined by broadcast


def seeded_order_key(id_col, seed: int) -> Column:
    """The seeded shuffle order — ``md5('<seed>:<id>')`` (ties by id).

    DuckDB's ``md5`` gives the same hex, so seeded samples / splits are
    reproducible by an oracle."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hex_bucket(hex_col, digits: int = 3) -> Column:
    """Bucket from the first ``digits`` hex digits (16**digits buckets)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def key_bounds(df: DataFrame, key: str) -> tuple[int, int]:
    """Min and max of an integer key: one narrow aggregate (a single-column
    scan when ``df`` is a table).  Compute it on the cheapest DataFrame that
    carries the key and pass it to :func:`range_bucket` via ``bounds``."""
    row = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return (row["lo"] or 0), (row["hi"] or 0)


def range_bucket(df: DataFrame, key: str, n_buckets: int = DEFAULT_BUCKETS,
                 bounds: tuple[int, int] | None = None) -> Column:
    """Fixed-width range bucket of an integer key (``n_buckets`` buckets over
    ``bounds``; the bounds are read from ``df`` when not given)."""
    lo, hi = bounds if bounds is not None else key_bounds(df, key)
    width = max(1, -(-(hi - lo + 1) // max(1, n_buckets)))
    return F.floor((F.col(key) - F.lit(lo)) / F.lit(width)).cast("bigint")


def default_buckets(spark) -> int:
    """Bucket count for two-level ranks: 8 per core, between 64 and 4096 —
    enough tasks to keep a cluster busy, and an offset table that is always
    small enough to broadcast."""
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:
        cores = 8
    return max(64, min(4096, 8 * cores))


def with_quantile_bucket(df: DataFrame, key: str, out: str = "_qb", source: DataFrame | None = None,
                         n_buckets: int | None = None) -> DataFrame:
    """Add ``out`` = an *equal-count* range bucket of the numeric ``key``.

    Boundaries are approximate quantiles of ``key`` over ``source`` (default
    ``df``; pass the table scan when ``df`` is expensive to recompute): one
    distributed sketch pass returns ``n_buckets - 1`` numbers.  Rows are
    assigned by ``Bucketizer`` (a JVM binary search).  Unlike fixed-width
    ranges, a dense cluster of keys cannot put a third of the rows into one
    bucket, i.e. into one task of the per-bucket window."""
    from pyspark.ml.feature import Bucketizer
    n = n_buckets or default_buckets(df.sparkSession)
    src = source if source is not None else df
    qs = src.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    inner = sorted({float(q) for q in qs if q is not None and not math.isinf(q)})
    splits = [-math.inf] + inner + [math.inf]
    tmp = f"{out}_key"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, F.col(key).cast("double")))
            .withColumn(out, F.col(out).cast("bigint")).drop(tmp))


def _bounded(offs: DataFrame, part: list) -> DataFrame:
    """Broadcast the offset table only when its size is bounded by the bucket
    count alone; with group keys its size grows with the number of groups, so
    the join strategy is left to the optimizer / AQE."""
    return F.broadcast(offs) if not part else offs


def _offsets(df: DataFrame, bucket: str, weight: Column | None, part: list) -> DataFrame:
    """Per-bucket exclusive offsets: sum of weights of all earlier buckets
    (within each ``part`` group).

    The window runs over the aggregated bucket table (at most n_buckets rows
    per group), never over the data."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per = df.groupBy(*part, bucket).agg(w.cast("bigint").alias("_bw"))
    win = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*part, bucket,
                      F.coalesce(F.sum("_bw").over(win), F.lit(0)).cast("bigint").alias("_off"))


def global_position(df: DataFrame, order: list, bucket: Column, name: str = "idx",
                    partition_by: list | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order ``order``
    (within each ``partition_by`` group, if given).

    ``bucket`` must be monotone in ``order`` (rows of a smaller bucket come
    first).  ``order`` should be unique (append an id for ties)."""
    part = list(partition_by or [])
    b = df.withColumn("_bkt", bucket)
    offs = _offsets(b, "_bkt", None, part)
    w = Window.partitionBy(*part, "_bkt").orderBy(*order)
    return (b.join(_bounded(offs, part), [*part, "_bkt"])
            .withColumn(name, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("_bkt", "_off"))


def global_prefix_sum(df: DataFrame, order: list, bucket: Column, value: Column,
                      name: str = "offset", inclusive: bool = False,
                      partition_by: list | None = None) -> DataFrame:
    """Add ``name`` = running sum of ``value`` over rows before this one in
    ``order`` (exclusive by default), within each ``partition_by`` group.
    Same two-level plan as :func:`global_position`: a group holding a third
    of all rows is still spread over its buckets."""
    part = list(partition_by or [])
    b = df.withColumn("_bkt", bucket).withColumn("_val", value.cast("bigint"))
    offs = _offsets(b, "_bkt", F.col("_val"), part)
    hi = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = F.coalesce(F.sum("_val").over(w), F.lit(0))
    return (b.join(_bounded(offs, part), [*part, "_bkt"])
            .withColumn(name, (F.col("_off") + local).cast("bigint"))
            .drop("_bkt", "_off", "_val"))


def running_sums(df: DataFrame, order: list, bucket: Column, values: dict,
                 partition_by: list | None = None) -> DataFrame:
    """Inclusive running sums of several DOUBLE columns (``name -> Column``) in
    ``order`` within ``partition_by`` groups; two-level like the above."""
    part = list(partition_by or [])
    b = df.withColumn("_bkt", bucket)
    for n, v in values.items():
        b = b.withColumn(f"_v_{n}", v.cast("double"))
    per = b.groupBy(*part, "_bkt").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    win = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*part, "_bkt", *[F.coalesce(F.sum(f"_s_{n}").over(win), F.lit(0.0)).alias(f"_o_{n}")
                                      for n in values])
    w = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(_bounded(offs, part), [*part, "_bkt"])
    for n in values:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w))
    return out.drop("_bkt", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def first_wins(df: DataFrame, key, order: list, rank_name: str = "_rn") -> DataFrame:
    """keep the first row per ``key`` in ``order``.

    ``row_number() = 1`` over a partitioned window plans as
    WindowGroupLimit(partial) -> Exchange -> WindowGroupLimit(final): a key
    repeated millions of times is cut to one row per input partition before the
    shuffle, so hot keys do not concentrate in one task."""
    keys = key if isinstance(key, list) else [key]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) == 1).drop(rank_name)


def join_split_hot(rows: DataFrame, info: DataFrame, keys: list[str], n_rows: str, how: str = "inner",
                   total: int | None = None) -> DataFrame:
    """``rows`` joined to ``info`` (one row per key) without a hot key in one task.

    ``info`` has a column ``n_rows`` with (at least) the number of rows of each key.
    Keys with more than a thousandth of all rows, fewer than a thousand by
    arithmetic, are broadcast, so that their rows stay where they are; all others
    are joined as the optimizer sees fit.  ``total`` defaults to the sum of
    ``n_rows``.  ``how``: ``inner`` or ``left``."""
    if total is None:
        total = info.agg(F.coalesce(F.sum(n_rows), F.lit(0))).first()[0]
    hot = F.col(n_rows) * HOT_SHARE > F.lit(total)
    marks = info.where(hot).select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(info.where(~hot).drop(n_rows), keys, how)
    held = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(info.where(hot).drop(n_rows)), keys)
    return cold.unionByName(held)


def stored_in_order(df: DataFrame, order: list, name: str = "ordered", out: str = "_part") -> DataFrame:
    """``df`` range-sorted by any sortable columns and stored, with the range it
    stands in: a bucket for :func:`global_position` that needs no numeric key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id().cast("bigint")), name)
