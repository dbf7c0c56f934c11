"""Spark session helpers.

The library never hard-codes a machine-local scratch folder: lineage cuts go to
``spark.checkpoint.dir`` as configured on the cluster. Only when that setting is
absent (unit tests, a laptop) do we pick a private temp folder.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC day arithmetic, AQE for runtime re-planning
# (coalescing small shuffles, splitting skewed join partitions), no web UI.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pastcast", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("PASTCAST_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring the cluster setting.

    ``spark.checkpoint.dir`` (shared storage on a cluster) wins; a temp folder
    is created only when nothing is configured and the master is local; without
    the setting a cluster job fails here instead of writing where others cannot read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="pastcast-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as columns under the shared ``spark.checkpoint.dir``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Session settings for the actions of a block (dots written as two underscores); what they were is set again after it."""
    names = {name.replace("__", "."): str(value) for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ensure_session_defaults(spark: SparkSession) -> None:
    """Apply the UTC / AQE settings to a session we did not build ourselves."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        try:
            spark.conf.set(k, BASE_CONF[k])
        except Exception:  # static conf on some deployments
            pass
    ensure_checkpoint_dir(spark)
