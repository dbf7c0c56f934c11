"""Shared helpers: tables in the shared folder, distributed running sums."""
from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pastcast.session import ensure_checkpoint_dir

#: The words of a text are the runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def div(x, y) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", x if isinstance(x, Column) else F.col(x), y if isinstance(y, Column) else F.lit(y))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; gone when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a reread, and values such as partition numbers stay what they were.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a string column each, or one row if that has more."""
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """A session setting for the actions of a block; what it was before is set again after it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Give freed memory of this worker back to the machine: the next task, of any stage, finds it there."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def dealt_in_order(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written, with the range number in ``__part`` (ascending)."""
    return materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)


def running_sum(df: DataFrame, order: Sequence[Column], weight: Column, label: str) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over all rows that come earlier in ``order``.

    Rows are dealt by range, summed within each range, and shifted by the totals of the ranges
    before; only the totals (a row per partition) meet in one task. Ties in ``order`` get
    consecutive places; rows that are equal in it must be interchangeable.
    """
    dealt = dealt_in_order(df.withColumn("__w", weight.cast("long")), order, label)
    totals = dealt.groupBy("__part").agg(F.sum("__w").alias("__total"))
    shift = totals.select("__part", (F.sum("__total").over(W.orderBy("__part").rowsBetween(
        W.unboundedPreceding, 0)) - F.col("__total")).alias("__shift"))
    within = F.sum("__w").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (dealt.withColumn("__sum", within).join(shift, "__part")
            .withColumn("before", F.col("__sum") - F.col("__w") + F.col("__shift"))
            .drop("__part", "__w", "__sum", "__shift"))


def block_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the earlier rows of the same ``group``.

    Within a group the order is by (hash block of ``order``, ``order``): any fixed order serves, and
    hash blocks split a group of any size over tasks, as many blocks as rows in each. ``df`` must be cheap to read twice and its
    rows distinct in ``group`` and ``order``; ``group`` columns must not be null.
    """
    blocks = math.isqrt(df.count()) + 1
    keyed = df.withColumn("__w", weight.cast("long")).withColumn(
        "__block", F.pmod(F.xxhash64(F.lit("block"), *[F.col(c) for c in order]), F.lit(blocks)))
    totals = keyed.groupBy(*group, "__block").agg(F.sum("__w").alias("__total"))
    shift = totals.select(*group, "__block", (F.sum("__total").over(W.partitionBy(*group, F.lit(1)).orderBy(
        "__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__total")).alias("__shift"))
    within = F.sum("__w").over(W.partitionBy(*group, "__block").orderBy(*order)
                               .rowsBetween(W.unboundedPreceding, 0))
    return (keyed.withColumn("__sum", within).join(shift, [*group, "__block"])
            .withColumn("before", F.col("__sum") - F.col("__w") + F.col("__shift"))
            .drop("__block", "__w", "__sum", "__shift"))
