"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..n-1, its place is the keyed permutation of that number, and
shard = place mod shards, slot = place div shards: shard and slot are computable from the number
and back, shards differ by at most one row (law ``rows``), and slots run from 0 without a gap.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_offsets, div, materialise
from .feistel import permute, unpermute


def number_rows(df: DataFrame) -> DataFrame:
    """Adds ``row_number`` 0..n-1 and ``total`` n; a function of the table's content alone.

    Equal rows are counted before the shuffle and numbered as a run, so a row repeated any number
    of times costs one row until the end. Nulls in any column are values like others. An empty
    table stays empty. Columns named row_number, total, copies or before would clash: name none so.
    """
    columns = df.columns
    distinct = materialise(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")), "rows")
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    placed = block_offsets(distinct.withColumn("__all", F.lit(0)), ["__all"], columns, F.col("copies"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return (placed.select(*columns, "before", each.alias("__copy"))
            .select(*columns, (F.col("before") + F.col("__copy")).alias("row_number"),
                    F.lit(total).cast("long").alias("total")))


def locate(row_number: Column, total: Column, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a global row number."""
    place = permute(row_number, total, F.lit(seed))
    return F.pmod(place, F.lit(shards)).cast("int"), div(place, shards)


def row_at(shard: Column, slot: Column, total: Column, shards: int, seed: int = 0) -> Column:
    """The global row number that :func:`locate` puts at (shard, slot)."""
    return unpermute(slot * shards + shard, total, F.lit(seed))


def assign_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with row_number, shard and slot. Pass the slim columns that tell rows apart."""
    numbered = number_rows(df)
    columns = [c for c in numbered.columns if c != "total"]
    place = numbered.withColumn("__place", permute(F.col("row_number"), F.col("total"), F.lit(seed)))
    return place.select(*columns, F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
                        div("__place", shards).alias("slot"))
