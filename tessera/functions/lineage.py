"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is local, as in
    tests, a temporary folder is made and set for the rest of the session.
    """
    defined = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or (defined.get() if defined.isDefined() else None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not defined.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint: rows in the shared folder, removed once the frame is collected as garbage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what finished plans hold: broadcast tables on the driver and on every executor, shuffles and checkpoints.

    Spark's cleaner removes them once the driver has collected their plans as garbage, which a driver with a large heap
    does late: an operator of many small plans would keep most of them until it ends.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """For the rest of the session, Arrow batches for Python have about ``most`` bytes, unless the session has less.

    Batches are counted in rows otherwise: ten thousand texts at once are tens of megabytes, in the JVM as well as in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def written(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: columnar, so that later readers prune columns.

    under: a scratch folder that the caller discards.
    """
    path = f"{under}/{label}" if under else scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, label: str, column: str, then: Callable[[DataFrame], DataFrame], rounds: int = 1) -> Iterator[DataFrame]:
    """A table in the shared folder, for as long as the block lasts: the frame dealt out by a column, and what ``then``
    makes of it by aggregates and joins on that column.

    Joins and aggregates on the column read the table without another shuffle of its rows. In more than one round the
    frame is made again each time, but no more than that share of it is in the shuffle at once.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    name, parts = f"tessera_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(rounds):
        some = df.where(F.pmod(F.xxhash64(column), F.lit(rounds)) == k) if rounds > 1 else df
        then(some.repartition(parts, column)).write.bucketBy(parts, column).option("path", path).mode("append").saveAsTable(name)
        release(spark)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders through Hadoop's file system, whatever store they are in."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
