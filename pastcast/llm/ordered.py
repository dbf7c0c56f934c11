"""Rows in order within groups of any size: positions, and hashes of joined strings.

Both deal rows by ranges of (group, order), so that a group of any size is spread over tasks. What a
group's ranges need of each other goes through a table with a row per group and range.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise

#: Joined strings travel in pieces of about so many characters.
PIECE = 1 << 19


def numbered(df: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """Adds ``piece`` (a part of a group within one range, ascending), ``place`` (from 0 within the piece) and
    ``before`` (the group's rows in earlier pieces). ``group`` must not be null.

    The rows are written sorted; a row's number in its range is its number in its task.
    """
    dealt = materialise(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
                        .withColumn("__n", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumns({"piece": F.shiftright("__n", 33).cast("int"), "__n": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))})
    pieces = dealt.groupBy(group, "piece").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = F.sum("__rows").over(W.partitionBy(group).orderBy("piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("__rows")
    return (dealt.join(pieces.withColumn("before", earlier).drop("__rows"), [group, "piece"])
            .withColumn("place", F.col("__n") - F.col("__first")).drop("__n", "__first"))


def _runs(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    """Where the runs of rows with equal keys (the first columns) begin and end."""
    n = batch.num_rows
    if n < 2:
        return [(0, n)] * n
    changes = None
    for i in range(keys):
        column = batch.column(i)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changes = differs if changes is None else pc.or_(changes, differs)
    cuts = [0, *(pc.indices_nonzero(changes).to_numpy() + 1).tolist(), n]
    return list(zip(cuts, cuts[1:]))


def joined_sha256(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str) -> DataFrame:
    """(keys, sha256): lowercase hash of the ``text`` of all rows of a key, in order, joined by ``separator``.

    Keys must not be null; a null text counts as empty. Strings are joined where they lie, into pieces of
    about PIECE characters; only pieces meet by key, and a task holds one piece and one hash state at a time.
    """
    slim = df.select(*keys, *order, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kinds = dict(slim.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    glue, n_keys = separator.encode(), len(keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        kinds_of = None

        def row(key, parts):
            nonlocal made
            made += 1
            values = [*key, part, made, glue.join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds_of)], [*keys, "__part", "__made", "__piece"])

        for batch in batches:
            kinds_of = [*(batch.schema.field(i).type for i in range(n_keys)), pa.int32(), pa.int64(), pa.binary()]
            texts = batch.column(n_keys).cast(pa.binary())
            out = []
            for a, b in _runs(batch, n_keys):
                key = [batch.column(i)[a].as_py() for i in range(n_keys)]
                if key != now:
                    if held:
                        out.append(row(now, held))
                    now, held, size = key, [], 0
                for value in texts.slice(a, b - a).to_pylist():
                    held.append(value)
                    size += len(value) + 1
                    if size > PIECE:
                        out.append(row(now, held))
                        held, size = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield row(now, held)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds_of = None, None, None
        for batch in batches:
            kinds_of = [*(batch.schema.field(i).type for i in range(n_keys)), pa.string()]
            done = []
            for i in range(batch.num_rows):
                key, piece = [batch.column(c)[i].as_py() for c in range(n_keys)], batch.column(n_keys)[i].as_py()
                if key == now:
                    state.update(glue)
                else:
                    if state:
                        done.append([*now, state.hexdigest()])
                    now, state = key, hashlib.sha256()
                state.update(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds_of)], [*keys, "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*now, state.hexdigest()], kinds_of)], [*keys, "sha256"])

    by = [*keys, *order]
    joined = (slim.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, "__text")
              .mapInArrow(pieces, f"{named}, __part int, __made bigint, __piece binary"))
    return (joined.repartition(*keys).sortWithinPartitions(*keys, "__part", "__made").select(*keys, "__piece")
            .mapInArrow(hashes, f"{named}, sha256 string"))
