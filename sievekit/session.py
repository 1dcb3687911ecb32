"""Session helpers: a local session for tests and a shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    On a cluster the session is created by the launcher; this only sets the
    settings the library relies on when it creates the session itself.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.master(master or os.environ.get("SIEVEKIT_MASTER", "local[8]"))
        .appName("sievekit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small scan splits, so that a small input uses every core without a shuffle.
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEKIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when neither is set and the master is local (tests,
    bench) a fresh local folder is created and registered; on a cluster an
    unset folder is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder (a machine-local folder "
                         "is lost with its executor)")
    local = tempfile.mkdtemp(prefix="sievekit-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A new, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared scratch folder and read it back; with the path, for :func:`discard`."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stashed files that no later plan reads, and the shuffle files of plans that are gone.

    Spark deletes a shuffle's files when the driver collects what referred to it; a driver with memory to
    spare may not do so while a job runs, and its disks fill.
    """
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For row-local work that costs far more than reading: a small input may be
    a single file split. A scan of more splits than cores is left as it is, so
    large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used before an operator reads the same intermediate several times
    (quantile cuts, cell counts, final pass); a lost executor then re-reads
    the checkpoint instead of recomputing model scores.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
