"""Sessions and table access shared by the queries, the bench and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "lintlake") -> SparkSession:
    """A local session with the settings that the results rely on: UTC, ANSI off-by-need casts, AQE."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LINTLAKE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs on this machine (tests) one of our own. On a cluster it must be set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() or "")
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), "lintlake-shared")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: cuts lineage, survives lost executors, and nothing upstream runs twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names of stage tables and files: a name and a random id.
STAGE = re.compile(r"[a-z0-9-]+-[0-9a-f]{32}(\.[a-z]+)?")


def sweep(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Deletes stage tables in the shared folder that no running job can need any more, by age; returns how many went. Results read their last stage lazily, so nothing is deleted before its time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if STAGE.fullmatch(status.getPath().getName()) and status.getModificationTime() / 1000 < time.time() - older_than_hours * 3600:
            gone += fs.delete(status.getPath(), True)
    return gone


#: What a broadcast side may take, by the optimizer's estimate.
SMALL = 32 << 20


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if the optimizer proves it small; else as it is, so that the join is planned by size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Deals rows round-robin to all cores where a table is too small to be read in more splits than there are cores (of a file with few row groups most splits are empty); larger tables are left as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
