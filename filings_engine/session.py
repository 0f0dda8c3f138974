"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes
# (size-checked broadcast, skew split, partition coalescing); UTC keeps
# date/time results independent of the machine zone.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # joins on (doc, pos) may reuse a partitioning on doc alone (the statement
    # jobs shuffle the nodes of a page once)
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "filings_engine", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, configure the session externally and
    only call the operators."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("FE_DRIVER_MEMORY", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


#: Estimated bytes of one partition made by ``spread``.
SPREAD_BYTES = 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session names none (local tests) is a scratch folder set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="fe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, eager: bool = True, as_table: bool = False) -> DataFrame:
    """Cut lineage in the shared checkpoint folder (survives executor loss,
    unlike a local checkpoint).

    ``as_table=True`` writes a parquet table there and reads it back: later
    scans prune columns and push filters down, which a checkpointed RDD
    cannot; use it for wide tables read by many branches."""
    d = checkpoint_dir(df.sparkSession)
    if not as_table:
        return df.checkpoint(eager=eager)
    path = f"{d.rstrip('/')}/tables/fe_{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str | None = None, always: bool = False) -> DataFrame:
    """Repartition a CPU-heavy input (parsing, regex over whole texts) whose
    source gives fewer splits than there are task slots (e.g. one large row
    group).  A well-split scan is left alone.  ``always`` is for inputs behind a
    small shuffle that adaptive execution would coalesce into one task; the
    partitions then follow the estimated size, ``SPREAD_BYTES`` each, and are
    never fewer than a few per slot."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if not always and df.rdd.getNumPartitions() >= slots:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    target = max(4 * slots, -(-size // SPREAD_BYTES))
    return df.repartition(target, key) if key else df.repartition(target)
