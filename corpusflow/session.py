"""Session helpers: a tuned local session for tests / bench, and the
checkpoint folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "corpusflow") -> SparkSession:
    """Return the active session or build a local one.

    On a cluster the session already exists and its configuration wins;
    the settings below only apply when a new local session is created.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system); a job
    on a cluster without it is refused, because a machine-local folder would
    lose the parts that other executors write.  Only a ``local`` master (tests,
    bench) gets a scratch folder of its own when the setting is unset.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:                      # Connect session: the server's setting applies
        if not conf:
            raise RuntimeError("spark.checkpoint.dir must be set on the cluster")
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialize(df, name: str = "stage"):
    """Compute ``df`` once and cut its lineage: write it as a parquet table
    under the shared checkpoint folder and read it back.

    Used for results that several consumers read (vocabularies, offsets,
    model counts) and for iteration state (crawl levels, BPE words).  Unlike
    ``Dataset.checkpoint`` without a cache, the data is computed exactly
    once; unlike ``localCheckpoint``, it survives the loss of executors."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
