"""File sources and sinks (A1-A5, A9, A11, A15): typed parquet read and
read-through cache, binary file listing with signature quarantine, landing
plan, document path fields, CSV tables, dataset fingerprint."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: document naming and file signatures ----------------------
DOC_NAME_PATTERN = r"^([A-Za-z]+)_RT(\d+)_(\d{8})\.xls$"
DOC_NAME_FORMAT = "{type}_RT{venue}_{yyyymmdd}.xls"
WORKBOOK_MAGIC = "D0CF11E0"
PARQUET_MAGIC = "50415231"  # "PAR1"
# --- end of fixed values -----------------------------------------------------


def scan_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: read the long-form history with an explicit schema (no inference)."""
    return spark.read.schema(schema).parquet(path)


def write_history(df: DataFrame, path: str, use_cache: bool = True,
                  partition_by: Sequence[str] = ("event_year",)) -> DataFrame:
    """A2: read-through cache. If ``use_cache`` and the table exists, read it;
    otherwise write ``df`` (partitioned by year, so date filters prune
    folders) and read it back."""
    spark = df.sparkSession
    if use_cache:
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return spark.read.parquet(path)
    out = df
    if "event_year" in partition_by and "event_year" not in df.columns:
        out = df.withColumn("event_year", F.year("event_date"))
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def list_documents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A3: recursive listing (path, length, modificationTime) sorted by path;
    the content column is never read here (column pruning on binaryFile)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root))
    return files.select("path", "length", "modificationTime").orderBy("path")


#: File systems of which a task opens a file and reads its first bytes; of others Spark reads files whole.
HEAD_SCHEMES = ("file", "hdfs")


def document_heads(spark: SparkSession, root: str, n: int, glob: str = "*") -> DataFrame:
    """A4: (path, length, content) of the files in ``root``, ``content`` being the first ``n`` bytes: a file of any
    size costs a task these bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    scheme = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if scheme not in HEAD_SCHEMES:
        return files.select("path", "length", F.substring("content", 1, n).alias("content"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = pa.fs.LocalFileSystem()
        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                place = (local, "/" + path.removeprefix("file:").lstrip("/")) if scheme == "file" else pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
                with place[0].open_input_file(place[1]) as f:
                    heads.append(f.read(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], ["path", "length", "content"])

    return files.select("path", "length").mapInArrow(read, "path string, length bigint, content binary")


def signature_quarantine(files: DataFrame, magic_hex: str = WORKBOOK_MAGIC):
    """A4: accept files whose first bytes equal ``magic_hex``; everything else
    goes to the rejects output with a reason. Only the first bytes are used."""
    n = len(magic_hex) // 2
    head = F.hex(F.substring("content", 1, n))
    tagged = files.withColumn("_head", head)
    good = tagged.where(F.col("_head") == magic_hex).drop("_head", "content")
    bad = (tagged.where((F.col("_head") != magic_hex) | F.col("_head").isNull())
           .select("path", "length", F.lit("bad_signature").alias("reason"), F.col("_head").alias("head")))
    return good, bad


def landing_plan(wanted: DataFrame, landed: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """A5: documents still to fetch = wanted minus landed (anti join), unless
    ``force`` (then everything wanted)."""
    if force:
        return wanted
    return wanted.join(landed.select(*keys).distinct(), list(keys), "left_anti")


def document_name(doc_type, venue, day) -> F.Column:
    """``<Type>_RT<venue>_<yyyymmdd>.xls``."""
    return F.concat(doc_type, F.lit("_RT"), venue.cast("string"), F.lit("_"),
                    F.date_format(day, "yyyyMMdd"), F.lit(".xls"))


def document_fields(name) -> list:
    """Type, venue and date out of a document name; bad dates -> NULL."""
    return [F.nullif(F.regexp_extract(name, DOC_NAME_PATTERN, 1), F.lit("")).alias("doc_type"),
            F.nullif(F.regexp_extract(name, DOC_NAME_PATTERN, 2), F.lit("")).try_cast("int").alias("venue_id"),
            F.try_to_date(F.nullif(F.regexp_extract(name, DOC_NAME_PATTERN, 3), F.lit("")), "yyyyMMdd")
            .alias("doc_date")]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV source with an explicit schema."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content version: row count, XOR and SUM of a
    60-bit md5 prefix of each row (NULL written as a marker). The SUM keeps
    pairs of equal rows from cancelling out as they would in the XOR."""
    cols = list(cols or df.columns)
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))
