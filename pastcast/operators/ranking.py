"""Order statistics without a single-task global sort.

``global_prefix`` computes exact running sums over a total order of a
(distinct-value) table in three distributed steps:

1. the rows are dealt by ranges of (group, order column) and kept with
   the number of their range, so the number survives a lost executor;
2. per-range totals (one row per group and range) are prefix-summed in a tiny
   window;
3. inside each range a window adds the local running sum to the range's offset.

The ranges only balance the work - results are exact whatever they are. On
top of it: exact quantiles (linear interpolation, as numpy / DuckDB
``quantile_cont``) and exact ROC-AUC / average precision (metrics.py).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept


def global_prefix(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                  by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` (inclusive running sum in ascending ``order_col``
    within ``by``) and ``tot_<c>`` (group total) for each ``c``. ``order_col``
    must be unique within ``by`` (feed it a distinct-value table). ``buckets``
    sets the number of ranges; by default Spark does."""
    ranges = [F.col(c) for c in [*by, order_col]]
    d = kept((df.repartitionByRange(buckets, *ranges) if buckets else df.repartitionByRange(*ranges))
             .withColumn("_b", F.spark_partition_id()))
    tot = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*by)
    tot = tot.select(*by, "_b",
                     *[F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_bb_{c}")
                       for c in sum_cols],
                     *[F.sum(f"_bt_{c}").over(wg).alias(f"tot_{c}") for c in sum_cols])
    wi = (Window.partitionBy(*by, "_b").orderBy(order_col)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.select("*", *[F.sum(c).over(wi).alias(f"_ci_{c}") for c in sum_cols])
    out = d.join(tot, [*by, "_b"])
    return out.select(*[F.col(c) for c in df.columns],
                      *[(F.col(f"_bb_{c}") + F.col(f"_ci_{c}")).alias(f"cum_{c}") for c in sum_cols],
                      *[F.col(f"tot_{c}") for c in sum_cols])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(*by, col)
            .agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between the order statistics
    at ``floor(h)`` and ``floor(h)+1``, ``h = (n-1)*q``. Returns rows
    ``(*by, qi, q, value)``. The value at 0-based rank r is the one with
    ``cum - n <= r < cum``: two conditional aggregates per probability find
    both, so there is no join and no value list is ever collected."""
    return quantiles_of_counts(value_counts(df, col, by), col, probs, by)


def quantiles_of_counts(counts: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` of values that are counted already: one row per (by, col), its count in ``_n``."""
    vc = global_prefix(counts, col, ["_n"], by)
    n, v = F.col("tot__n"), F.col(col).cast("double")
    at = lambda r: F.max(F.when((F.col("cum__n") - F.col("_n") <= r) & (r < F.col("cum__n")), v))
    aggs, items = [], []
    for i, q in enumerate(probs):
        h = F.lit(float(q)) * (n - 1).cast("double")
        lo = F.floor(h).cast("long")
        aggs += [at(lo).alias(f"_x0_{i}"), at(F.least(lo + 1, n - 1)).alias(f"_x1_{i}"),
                 F.max(h - lo.cast("double")).alias(f"_f_{i}")]
        x0, x1 = F.col(f"_x0_{i}"), F.col(f"_x1_{i}")
        items.append(F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q"),
                              (x0 + F.col(f"_f_{i}") * (x1 - x0)).alias("value")))
    # an ungrouped aggregate of an empty table is a row of nulls: no quantile
    return vc.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*items))).where(F.col("value").isNotNull())
