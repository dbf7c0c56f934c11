"""A registry of fitted models (A14): names, versions, stages, on shared storage.

The registry is a folder with a numbered log, one small JSON file per record, and the saved models. A record
is published by creating its file only if there is none of that number, so that of two writers one gets the
number and the other reads the log again. A model is saved in a folder of its own before its record is
published: a reader never sees a half-written model, and a writer that is lost leaves no record.

``resolve`` gives the latest version of a stage, else the fallback path, else an error.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import _fs_exists, _fs_path

LOG_SCHEMA = "seq BIGINT, op STRING, name STRING, version INT, stage STRING, path STRING, params STRING, metrics STRING"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text`` unless there is one; False if there is. Readers see all of it or nothing."""
    p, fs = _fs_path(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}.tmp")  # names with _ are not read
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            # A local rename replaces its target; a hard link does not.
            local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(fs.makeQualified(p)), local(fs.makeQualified(aside)))
        else:
            options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(aside), fs.makeQualified(p), spark.sparkContext._gateway.new_array(options, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    finally:
        fs.delete(aside, False)


class ModelRegistry:
    """Models under ``root``, a folder that all users of the registry share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        folder, fs = _fs_path(spark, f"{self.root}/log")
        fs.mkdirs(folder)

    def log(self) -> DataFrame:
        """All records, in the order of ``seq``."""
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/log")

    def versions(self) -> DataFrame:
        """(name, version, stage, path, params, metrics): every version with its latest stage, null if it had none."""
        log = self.log()
        stages = log.where("op = 'stage'").groupBy("name", "version").agg(F.max_by("stage", "seq").alias("stage"))
        return (log.where("op = 'register'").select("name", "version", "path", "params", "metrics")
                .join(stages, ["name", "version"], "left").select("name", "version", "stage", "path", "params", "metrics"))

    def _append(self, record: Callable[[list], dict]) -> dict:
        """Publish the record that ``record`` makes of the log, under the next number; again if another writer had it first."""
        while True:
            rows = self.log().collect()  # a record per version and change of stage
            new = dict(record(rows), seq=max((r.seq for r in rows), default=0) + 1)
            if put_if_absent(self.spark, f"{self.root}/log/{new['seq']:012d}.json", json.dumps(new)):
                return new

    def publish(self, name: str, save: Callable[[str], None], params: dict | None = None, metrics: dict | None = None,
                stage: str | None = None) -> int:
        """Save a model with ``save(path)`` and give it the next version of ``name``, in ``stage`` if one is named."""
        path = f"{self.root}/models/{uuid.uuid4().hex}"
        save(path)

        def record(rows):
            latest = max((r.version for r in rows if r.op == "register" and r.name == name), default=0)
            return {"op": "register", "name": name, "version": latest + 1, "path": path,
                    "params": json.dumps(params or {}, sort_keys=True), "metrics": json.dumps(metrics or {}, sort_keys=True)}

        version = self._append(record)["version"]
        if stage is not None:
            self.set_stage(name, version, stage)
        return version

    def set_stage(self, name: str, version: int, stage: str) -> None:
        def record(rows):
            if not any(r.op == "register" and (r.name, r.version) == (name, version) for r in rows):
                raise LookupError(f"no version {version} of {name}")
            return {"op": "stage", "name": name, "version": version, "stage": stage}
        self._append(record)

    def resolve(self, name: str, stage: str, fallback: str | None = None) -> tuple[str, int | None]:
        """(path, version) of the latest version of ``name`` in ``stage``; else (fallback, None) if that exists; else LookupError."""
        best = (self.versions().where((F.col("name") == name) & (F.col("stage") == stage))
                .agg(F.max_by(F.struct("path", "version"), "version").alias("m")).select("m.*").first())
        if best.path is not None:
            return best.path, best.version
        if fallback is not None and _fs_exists(self.spark, fallback):
            return fallback, None
        raise LookupError(f"no version of {name} in stage {stage}, and no model at {fallback}")
