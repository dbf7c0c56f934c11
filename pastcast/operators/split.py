"""Temporal split and exact sampling.

The quantile cutoff never sorts rows globally: rows are first reduced to one
count per distinct day (a partial aggregate), and only that calendar-sized
table is ordered. The cutoff is returned as a one-row DataFrame and applied
as a scalar subquery, so nothing but a date ever leaves the executors.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quantile_cutoff(df: DataFrame, test_size: float = 0.2, date_col: str = "event_date") -> DataFrame:
    """Date at row index ``rint((n-1)*(1-test_size))`` of the date-sorted
    rows (numpy ``nearest`` = half to even). One row, column ``cutoff``."""
    if test_size is None or not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1) for the quantile strategy")
    if date_col not in df.columns:
        raise KeyError(f"Column {date_col!r} not in DataFrame")
    q = float(1 - test_size)
    daily = (df.where(F.col(date_col).isNotNull())
             .groupBy(F.col(date_col).cast("date").alias("d")).agg(F.count(F.lit(1)).alias("c")))
    # the window spans distinct days only (bounded by the calendar, not by rows)
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = daily.select("d", F.sum("c").over(w).alias("cum"),
                       F.sum("c").over(Window.partitionBy()).alias("n"))
    return (cum.where(F.col("cum") > F.rint((F.col("n") - 1).cast("double") * F.lit(q)))
            .agg(F.min("d").alias("cutoff")))


def temporal_split(df: DataFrame, cutoff=None, test_size: float | None = 0.2,
                   date_col: str = "event_date", strategy: str = "quantile"):
    """Returns ``(train, test, cutoff_df)``; train has
    ``date < cutoff``, test ``date >= cutoff`` (rows on the cutoff day go to
    test). An explicit ``cutoff`` always wins; unknown strategies raise."""
    if date_col not in df.columns:
        raise KeyError(f"Column {date_col!r} not in DataFrame")
    if strategy not in ("quantile", "cutoff"):
        raise ValueError(f"unknown split strategy {strategy!r}")
    if strategy == "cutoff" and cutoff is None:
        raise ValueError("strategy='cutoff' needs an explicit cutoff date")
    spark = df.sparkSession
    if cutoff is not None:
        cut_df = spark.range(1).select(F.lit(str(cutoff)).cast("date").alias("cutoff"))
    else:
        cut_df = quantile_cutoff(df, test_size, date_col)
    c = cutoff_value(cut_df)
    d = F.col(date_col).cast("date")
    return df.where(d < c), df.where(d >= c), cut_df


def cutoff_value(cut_df: DataFrame) -> Column:
    """The cutoff as a scalar-subquery Column (evaluated once by Spark)."""
    return cut_df.select("cutoff").scalar()


def nested_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.2,
                 date_col: str = "event_date"):
    """Split off test, then split train again into inner-train / validation."""
    train, test, cut = temporal_split(df, test_size=test_size, date_col=date_col)
    inner, val, vcut = temporal_split(train, test_size=val_size, date_col=date_col)
    return inner, val, test, cut, vcut


def sample_exact(df: DataFrame, n: int, seed: int, id_cols: list[str]) -> DataFrame:
    """``n`` rows without replacement, reproducible anywhere: order by
    md5(seed || id) and keep the first ``n`` (a top-k, not a full sort)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
    return df.withColumn("_sk", key).orderBy("_sk", *id_cols).limit(n).drop("_sk")
