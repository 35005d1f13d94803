"""Spark session and lineage helpers.

The library never creates its own session inside an operator: every public
function takes DataFrames (or a session) from the caller.  ``local_session``
exists for tests, ``bench.py`` and the driver smoke entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "credence") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CREDENCE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder used to cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; that setting always wins.
    Only a local-mode session without the setting (tests, bench) gets a fresh
    scratch folder of its own.  A session without a driver-side context
    (Spark Connect) uses the server's setting as it is.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; a cluster run needs a shared checkpoint folder")
        configured = tempfile.mkdtemp(prefix="credence-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext; the server's owner cleans its folder
        return path
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Used after the expensive text stages so that a lost executor re-reads the
    checkpoint instead of re-tokenising the corpus, and so that every later
    job shares one computation.  Reliable checkpoints keep the output
    partitioning, so a table partitioned by ``doc_id`` stays co-located.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors (memory, spilling to disk) for the next steps.

    Unlike a reliable checkpoint, a cached relation keeps its known output
    partitioning, so a table hash-partitioned by ``doc_id`` feeds later
    per-document windows and aggregations without another exchange.  Lost
    blocks are recomputed from the preceding shuffle output.
    """
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# Largest model tables the library broadcasts to every task (rows).  Fitted
# state (vocabulary, moments, centroid values, cluster statistics) is checked
# against it when it is created, so a broadcast can never grow with the data.
MAX_BROADCAST_ROWS = 2_000_000


def check_broadcast_size(rows: int, what: str, limit: int = MAX_BROADCAST_ROWS) -> int:
    if rows > limit:
        raise ValueError(f"{what} has {rows} rows; more than {limit} would not be broadcast "
                         f"safely -- lower the bound (e.g. max_features or k)")
    return rows
