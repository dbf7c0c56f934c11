"""Strict as-of state join at day grain — the engine behind every
point-in-time feature.

Problem: for each *target* row (key k, day d) aggregate all *history* rows of
the same key with day < d (optionally day >= d - lookback).

A theta join ``h.key = t.key AND h.day < t.day`` is quadratic per key, and a
row-level window partitioned by key puts an entire hot key into one task. We
avoid both:

1. ``day_states`` pre-aggregates history to one row per (key, day) with
   decomposable partial states (counts, sums, min/max, first-of-day, last-k of
   day). The shuffle carries partially aggregated rows; a hot (key, day) group
   is split over ``salt_buckets`` sub-groups before its top-k is merged, so no
   task ever holds a whole hot group.
2. ``stack_probes`` unions those day rows (side=1) with the distinct target
   probes (side=0) and the caller runs cumulative windows partitioned by key,
   ordered by (day, side): a probe precedes same-day history, so same-day
   outcomes are invisible (strictness without date arithmetic). Rows per key
   are bounded by the number of distinct days, not by the number of events.
3. Results are keyed by the probe columns and attached back to targets with an
   equi-join where they are, partitioned by the entity alone: the targets of a
   very frequent entity meet in one task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = "_day"      # unix day number (INT) of the event
SIDE = "_side"    # 0 = probe (target), 1 = history


def day_number(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_date(c.cast("date"))


def salted_top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
                 salt_buckets: int, aggs: Sequence[Column],
                 topk_fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per group of ``keys``: ``aggs`` (decomposable: they must be re-aggregated
    by the caller's merge) plus, for each entry of ``topk_fields``
    ``name -> (filter, struct)``, the ``k`` rows with the largest ``order``
    among rows passing ``filter``, as an array sorted descending.

    Two levels: rows are hashed into ``salt_buckets`` sub-groups, ranked there
    (one window sort per sub-group), then at most ``k * salt_buckets`` structs
    per group are merged. The collected arrays are bounded by that constant.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt_buckets)).cast("int")
    sub = [*keys, "_salt"]
    w = Window.partitionBy(*sub).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("_salt", salt)
    rank_cols = []
    for name, (flt, _) in topk_fields.items():
        # running count of qualifying rows in descending order = rank among them
        ranked = ranked.withColumn(
            f"_rk_{name}",
            F.sum(F.when(flt, 1).otherwise(0)).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rank_cols.append(name)
    partial = ranked.groupBy(*sub).agg(
        *aggs,
        *[F.collect_list(F.when(flt & (F.col(f"_rk_{n}") <= k), st)).alias(n)
          for n, (flt, st) in topk_fields.items()])
    return partial


def merge_top_k(col: str, k: int) -> Column:
    """Final merge of the per-salt top-k arrays: concat, sort desc, keep k."""
    return F.slice(F.sort_array(F.flatten(F.collect_list(col)), asc=False), 1, k)


def lag_ignore_nulls(col: str, n: int, partition: Sequence[str], order: Sequence[str]) -> Column:
    """``lag(col, n) IGNORE NULLS`` — the n-th previous non-null value."""
    q = lambda c: f"`{c}`"
    spec = (f"PARTITION BY {', '.join(map(q, partition))} "
            f"ORDER BY {', '.join(map(q, order))}")
    return F.expr(f"lag({q(col)}, {n}) IGNORE NULLS OVER ({spec})")


def cumulative(partition: Sequence[str], order: Sequence[str | Column]):
    """Frame over all earlier rows of (day, side): evaluated incrementally in one
    pass, and strict because a probe sorts before same-day history."""
    return (Window.partitionBy(*partition).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


#: Keys of targets that are sent to every task to cut a history down; more of them are joined by a shuffle.
SENT_KEYS = 1_000_000


def only_keys(rows: DataFrame, key: str, targets: DataFrame, target_key: str | None = None,
              sent_keys: int = SENT_KEYS) -> DataFrame:
    """The ``rows`` whose ``key`` some target has: what a job for few targets reads of a long history never
    reaches a shuffle. The targets' keys are counted first; at most ``sent_keys`` are broadcast."""
    keys = targets.select(F.col(target_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    few = len(keys.limit(sent_keys + 1).groupBy().agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= sent_keys).take(1))
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


#: Rows of a key above which they are aggregated before they are dealt out by that key.
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows: at most one for so many rows, few enough to be sent to every task."""
    return F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key))


def dealt_by(rows: DataFrame, key: str, hot: DataFrame, states: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``states(rows)``, hash partitioned by ``key``; ``states`` keeps the key and makes each of its rows from rows of one key.

    Rows are dealt out as they are, once. Those of ``hot_keys`` are aggregated over all tasks before they are dealt out."""
    return (states(rows.join(hot, key, "left_anti").repartition(key))
            .unionByName(states(rows.join(hot, key, "left_semi")).repartition(key)))


#: Shuffled bytes that a task of the feature job reads at most, where rows can be dealt out so: its sorts, windows and
#: joins of wide rows hold many times that at once, and what a task cannot hold is spilled.
TASK_BYTES = 16 << 20


def co_partition(spark: SparkSession) -> None:
    """Joins on a key and more columns keep rows that are dealt out by that key where they are, in tasks that are small."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> None:
    """Fail early (at plan time) with the list of missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")


def unique_columns(df: DataFrame) -> DataFrame:
    """The output must never carry two columns with one name."""
    seen, dups = set(), []
    for c in df.columns:
        if c in seen:
            dups.append(c)
        seen.add(c)
    if dups:
        raise RuntimeError(f"duplicate output columns: {dups}")
    return df
