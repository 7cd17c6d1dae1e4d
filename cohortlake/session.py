"""Session helpers shared by tests, bench and the registered queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # no Python call-site capture per column expression: building wide plans is 10x faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen in local mode, where driver and
    executors are one process; on a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlake-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def at_once(*makers: Callable) -> list:
    """What each of some independent makers returns, in their order. Their jobs run side by side: the cores that the last tasks
    of one leave idle, and the time the driver takes to plan another, are not waited for."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(len(makers)) as pool:
        return [x.get() for x in [pool.apply_async(inherit(make)) for make in makers]]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used before multi-pass work (model fitting): lineage is cut by a written
    table, so a lost executor re-reads files instead of replaying the pipeline.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def superseded(df: DataFrame) -> None:
    """Delete the table that :func:`materialize` wrote for ``df``, which nothing will read any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
