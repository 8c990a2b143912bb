"""What the corpus operators share: the shared folder, written stages, and a join that survives hot keys."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import shared_dir, sweep, written  # noqa: F401

#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so at most HOT_SHARE keys are hot, and a table of them can be broadcast whatever the input's size.
HOT_SHARE = 1000
#: The six characters the contracts count as white space.
SPACES = b" \t\n\x0b\x0c\r"


def ready(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, also where the session was started from another folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications, on their own session: at most 1000 rows in an Arrow batch, as whole texts are large rows. Operators work with any size and leave the session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(1000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    return spark


#: Bytes of the input's files for a task of an explicit shuffle.
TASK_BYTES = 256 << 20


def tasks(spark: SparkSession, source: DataFrame | None = None) -> int:
    """Partitions for a shuffle by an explicit key, as the session sets them, and more where the source's files are larger than that many can take."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if source is not None else 0
    return max(n, min(1 << 20, size // TASK_BYTES if size < 1 << 60 else 0))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, so that a caller's other columns cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_hot(left: DataFrame, right: DataFrame, key: str, size: Column, total: int, spread: Column) -> DataFrame:
    """left LEFT JOIN right on key, where right has each key once and `size` tells how many rows of left share it.

    Keys with over 1/HOT_SHARE of `total` rows (at most HOT_SHARE of them) are joined by broadcast; their rows then
    travel under a key of their own (`spread`, a string of left's columns), so no task of the shuffled join gets more
    than one HOT_SHARE-th of the rows for one key.
    """
    names = [c for c in right.columns if c != key]
    packed = right.select(F.col(key).alias("_k"), F.struct(*names).alias("_v"), size.alias("_n"))
    limit = max(1, total // HOT_SHARE)
    hot = packed.filter(F.col("_n") > limit).select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    cold = packed.filter(F.col("_n") <= limit).select("_k", "_v")
    out = left.join(F.broadcast(hot), left[key] == F.col("_hk"), "left")
    out = out.withColumn("_j", F.when(F.col("_hk").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("hot "), spread)))
    cold = cold.withColumn("_k", F.col("_k").cast("string"))
    out = out.join(cold, F.col("_j") == F.col("_k"), "left").withColumn("_v", F.coalesce("_hv", "_v"))
    return out.select(*left.columns, *[F.col("_v")[n].alias(n) for n in names])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def regroup(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about `most` bytes of data (a longer row stands alone)."""
    for b in batches:
        if b.num_rows:
            step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
