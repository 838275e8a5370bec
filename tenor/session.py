"""Session construction and runtime tuning.

Only runtime-settable SQL confs are touched in :func:`tune`, so it is safe to
call on a session someone else built (a cluster session, the check driver's).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Caps in this library (10000 comments per year, 3000/4000 videos per year,
# 1000 review rows) are row_number() <= k filters. Catalyst turns them into a
# WindowGroupLimit that prunes before the shuffle only while k is at most this
# threshold (default 1000), so it is raised.
WINDOW_GROUP_LIMIT = 100_000


def tune(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(WINDOW_GROUP_LIMIT))
    # Whole texts go to Python where languages are told: batches are bounded in rows and in bytes.
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint folder; set ``fallback`` only where unset (tests)."""
    d = checkpoint_dir(spark)
    if d:
        return d
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "tenor", memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    partitions = partitions or int(os.environ.get("TENOR_SHUFFLE_PARTITIONS", "8"))
    scratch = tempfile.mkdtemp(prefix="tenor-")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, os.path.join(scratch, "checkpoints"))
    return tune(spark)
