"""Structured Streaming variants of landing, dedup, scoring and daily
volume (M1-M4).

All jobs read a file source incrementally (each file exactly once, tracked by
the query checkpoint), run with ``trigger(availableNow=True)`` so a scheduled
run drains what arrived and stops, and write to a sink whose commit log makes
re-runs idempotent. Checkpoints and sinks live under the caller's folder,
which should be on shared storage (``spark.checkpoint.dir``).
"""
from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(folder)


def with_event_time(df: DataFrame, col: str) -> tuple[DataFrame, str]:
    """Watermarks need TIMESTAMP (with local time zone); a TIMESTAMP_NTZ column
    is read as a UTC wall clock into ``_et``."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return df.withColumn("_et", F.col(col).cast("timestamp")), "_et"
    return df, col


def _drain(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_land(spark: SparkSession, source: str, schema: T.StructType, out: str,
                glob: str = "*.parquet") -> DataFrame:
    """M1: incremental ingest — every new file once, appended to ``out``."""
    s = file_stream(spark, source, schema, glob)
    _drain(s.writeStream.format("parquet").option("path", os.path.join(out, "data")).outputMode("append"),
           os.path.join(out, "_checkpoint"))
    return spark.read.schema(schema).parquet(os.path.join(out, "data"))


def stream_dedup(spark: SparkSession, source: str, schema: T.StructType, out: str,
                 keys: Sequence[str], event_time: str, delay: str = "1 hour",
                 glob: str = "*.parquet", derive: dict[str, Column] | None = None) -> DataFrame:
    """M2: keep-first per key on a stream; state for a key is kept until the
    watermark passes (event time + delay), then dropped. ``derive`` adds columns on the way in."""
    s, et = with_event_time(file_stream(spark, source, schema, glob).withColumns(derive or {}), event_time)
    d = s.withWatermark(et, delay).dropDuplicatesWithinWatermark(list(keys))
    if et != event_time:
        d = d.drop(et)
    _drain(d.writeStream.format("parquet").option("path", os.path.join(out, "data")).outputMode("append"),
           os.path.join(out, "_checkpoint"))
    return spark.read.parquet(os.path.join(out, "data"))


def stream_daily_counts(spark: SparkSession, source: str, schema: T.StructType, out: str,
                        event_time: str, positive: Callable[[], F.Column], delay: str = "1 day",
                        glob: str = "*.parquet") -> DataFrame:
    """M4: per-day volume and positive rate, each day emitted once, when the watermark (the latest event time of
    earlier batches less ``delay``) has passed its end. Rows of a day that the watermark had passed
    before their batch are late and dropped. Days that are still open stay in the state: the next run goes on there."""
    s, et = with_event_time(file_stream(spark, source, schema, glob), event_time)
    agg = (s.withWatermark(et, delay).groupBy(F.window(et, "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("n_events"), F.avg(positive().cast("double")).alias("rate"))
           .select(F.col("w.start").cast("date").alias("day"), "n_events", "rate"))
    data = os.path.join(out, "data")
    _drain(agg.writeStream.format("parquet").option("path", data).outputMode("append"), os.path.join(out, "_checkpoint"))
    return spark.read.schema("day DATE, n_events BIGINT, rate DOUBLE").parquet(data)


def stream_score(spark: SparkSession, source: str, schema: T.StructType, out: str,
                 score_batch: Callable[[DataFrame], DataFrame], glob: str = "*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """M3: score arriving targets inside ``foreachBatch``, against a state that is kept outside the stream
    (``operators.state``): a micro-batch never reads the history."""
    s = file_stream(spark, source, schema, glob, max_files)
    data = os.path.join(out, "data")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces itself
        score_batch(batch).write.mode("overwrite").parquet(f"{data}/batch_id={batch_id}")

    _drain(s.writeStream.foreachBatch(sink), os.path.join(out, "_checkpoint"))
    return spark.read.parquet(data)
