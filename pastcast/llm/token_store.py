"""Token ids on disk: zstandard with a shared dictionary, a frame per document.

A store is a folder with two Parquet tables. ``dictionary`` has one row: the zstandard dictionary,
trained on serialized id arrays, its hash, and the width of an id. ``segments`` has rows of some
thousand documents: the documents' frames end to end in ``blob``, and beside it the index, which
Parquet reads without the blob: ids, where each frame ends, token counts, the dictionary's hash.
A document is read by its frame alone; rows are in ascending order of ids, so that Parquet's
statistics of first_id and last_id lead to the segment.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import by_bytes, give_back, setting
from .tokens import encoder

DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on about so many documents, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 20_000
SEGMENT_BYTES = 1 << 20
LEVEL = 3
#: Texts encoded together, and sent to a worker in one batch, by bytes.
GROUP_BYTES = 4 << 20

SEGMENTS = ("part int, segment int, first_id {id}, last_id {id}, doc_ids array<{id}>, frame_ends array<bigint>, "
            "counts array<bigint>, total bigint, dictionary_hash string, blob binary")


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the arrays themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-DICTIONARY_BYTES:]


def _zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _sample(docs: DataFrame) -> list[str]:
    """About SAMPLE_DOCS short texts, chosen by a hash of the text; twice as many at most."""
    parts = 1 << 40
    cut = int(parts * min(1.0, SAMPLE_DOCS / max(1, docs.count())))
    h = F.pmod(F.xxhash64("text", F.lit("dictionary")), F.lit(parts))
    short = docs.select("text", h.alias("h")).filter(F.col("h") < cut).filter(F.length("text").between(1, SAMPLE_CHARS))
    return sorted(r[0] for r in short.orderBy("h", "text").limit(2 * SAMPLE_DOCS).select("text").collect())


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                tokenizer: str | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write a store at ``path`` (shared storage).

    Null and empty texts have the end id only. Rows that repeat an id keep a document each, ordered
    by a hash of the text; null ids come first. Other columns are not read. An empty table makes an
    empty store. Every machine needs the ``tokenizer`` file.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["id"]
    here = encoder(tokenizer)
    width = 2 if max(here.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
    sample = pa.array(_sample(slim), pa.string())
    ids, ends = here.encode(sample)
    data = ids.astype(f"<u{width}").tobytes()
    stops = (ends * width).tolist()
    dictionary = train_dictionary([data[a:b] for a, b in zip([0, *stops], stops)])
    digest = hashlib.sha256(dictionary).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(dictionary), digest, width)], "dictionary binary, hash string, width int").coalesce(
        1).write.parquet(f"{path}/dictionary")
    schema = SEGMENTS.format(id=kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd_dictionary(dictionary))
        worker = encoder(tokenizer)
        names, frames, counts = [], [], []
        fields, size = None, 0

        def flush():
            nonlocal segment, size
            row = {"part": part, "segment": segment, "first_id": names[0], "last_id": names[-1], "doc_ids": names[:],
                   "frame_ends": np.cumsum([len(f) for f in frames]).tolist(), "counts": counts[:], "total": sum(counts),
                   "dictionary_hash": digest, "blob": b"".join(frames)}
            segment, size = segment + 1, 0
            for x in (names, frames, counts):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=fields)

        for batch in batches:
            fields = fields or _arrow_schema(batch.schema.field(0).type)
            for rows in by_bytes(batch, 1, GROUP_BYTES):
                ids, ends = worker.encode(rows.column(1))
                low = ids.astype(f"<u{width}")
                last = np.array([end_id], f"<u{width}").tobytes()
                begin = 0
                for name, end in zip(rows.column(0).to_pylist(), ends.tolist()):
                    frames.append(compressor.compress(low[begin:end].tobytes() + last))
                    names.append(name)
                    counts.append(end - begin + 1)
                    size += len(frames[-1])
                    begin = end
                    if size >= SEGMENT_BYTES:
                        yield flush()
        if names:
            yield flush()
        worker.rest()
        give_back()

    order = [F.col("id"), F.xxhash64("text")]
    # A batch of 10,000 long texts would be held by Spark, the worker and the pipe between them.
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", GROUP_BYTES):
        (slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema)
         .write.option("compression", "none").parquet(f"{path}/segments"))


def _arrow_schema(kind: pa.DataType) -> pa.Schema:
    whole = pa.int64()
    return pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_id", kind), ("last_id", kind),
                      ("doc_ids", pa.list_(kind)), ("frame_ends", pa.list_(whole)), ("counts", pa.list_(whole)),
                      ("total", whole), ("dictionary_hash", pa.string()), ("blob", pa.binary())])


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    data, digest, width = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(data)).hexdigest() != digest:
        raise ValueError(f"the dictionary at {path} does not have its hash")
    return bytes(data), digest, width


def _decoded(segments: DataFrame, dictionary: tuple[bytes, str, int], with_ids: bool) -> DataFrame:
    """(id, part, segment, start in the segment, n_tokens, ids_crc32, ids) of all documents of segments."""
    data, digest, width = dictionary
    kind = dict(segments.dtypes)["first_id"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(data))
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                if cell["dictionary_hash"].as_py() != digest:
                    raise ValueError("a segment was written with another dictionary")
                blob, counts = memoryview(cell["blob"].as_buffer()), cell["counts"].values.to_numpy()
                begin, checks, ids = 0, [], []
                for end, n in zip(cell["frame_ends"].as_py(), counts.tolist()):
                    low = np.frombuffer(decompressor.decompress(blob[begin:end]), f"<u{width}")
                    if len(low) != n:
                        raise ValueError("a frame does not have its count of ids")
                    full = low.astype("<u4").tobytes()
                    checks.append(zlib.crc32(full))
                    if with_ids:
                        ids.append(full)
                    begin = end
                m = len(counts)
                yield pa.RecordBatch.from_arrays([
                    cell["doc_ids"].values, pa.array([cell["part"].as_py()] * m, pa.int32()),
                    pa.array([cell["segment"].as_py()] * m, pa.int32()), pa.array(np.cumsum(counts) - counts),
                    pa.array(counts), pa.array(checks, pa.int64()),
                    pa.array(ids, pa.binary()) if with_ids else pa.nulls(m, pa.binary())],
                    ["id", "part", "segment", "start", "n_tokens", "ids_crc32", "ids"])

    return segments.mapInArrow(unpack, f"id {kind}, part int, segment int, start bigint, n_tokens bigint, "
                                       "ids_crc32 bigint, ids binary")


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document of a store: id, start (ids of all documents before it), n_tokens with the end id,
    ids_crc32 (of the ids as little-endian 32-bit numbers) and ``ids``, those bytes, if asked for."""
    segments = spark.read.parquet(f"{path}/segments")
    # The index alone gives where each segment starts: within its part, then by the parts before.
    index = segments.select("part", "segment", "total")
    so_far = lambda w: F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("total")
    parts = index.groupBy("part").agg(F.sum("total").alias("total"))
    bases = (index.withColumn("inner", so_far(W.partitionBy("part").orderBy("segment")))
             .join(parts.select("part", so_far(W.orderBy("part")).alias("outer")), "part")
             .select("part", "segment", (F.col("inner") + F.col("outer")).alias("base")))
    found = _decoded(segments, _dictionary(spark, path), with_ids).join(bases, ["part", "segment"])
    columns = [F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id, id_col: str = "doc_id") -> DataFrame:
    """The documents with one id: Parquet skips the other segments by their statistics."""
    segments = spark.read.parquet(f"{path}/segments").filter(
        (F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    return _decoded(segments, _dictionary(spark, path), True).filter(F.col("id") == doc_id).select(
        F.col("id").alias(id_col), "n_tokens", "ids_crc32", "ids")
