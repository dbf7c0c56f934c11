"""Dataset profiling aggregates (E8-E19, E25, E28). Each is one or two
grouped aggregates with map-side combine; wide results are unpivoted with
``stack`` instead of collecting per-column answers on the driver."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import exact_quantiles


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def profile_summary(df: DataFrame, entity: str, rider: str, venue: str, date: str) -> DataFrame:
    """Rows, columns, distinct entities / riders / venues, date range, span
    in years (days / 365.25)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.count_distinct(entity).alias("n_entities"),
        F.count_distinct(rider).alias("n_riders"),
        F.count_distinct(venue).alias("n_venues"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"),
    ).withColumn("span_years", F.datediff("date_max", "date_min") / 365.25)


def null_profile(df: DataFrame) -> DataFrame:
    """Per column null count, null percentage (2 decimals) and type, sorted
    by percentage desc (then name)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"{_sql_str(c)}, {_sql_str(df.schema[c].dataType.simpleString())}, _z{i}"
                      for i, c in enumerate(df.columns))
    long = wide.selectExpr("_n", f"stack({len(df.columns)}, {pairs}) AS (column_name, dtype, null_count)")
    return long.select("column_name", "dtype", F.col("null_count").cast("long").alias("null_count"),
                       F.round(F.col("null_count") * 100.0 / F.col("_n"), 2).alias("null_pct"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count per class, share within labelled rows, labelled share."""
    g = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window
    w = Window.partitionBy()  # over at most 3 rows (0, 1, NULL)
    lab_total = F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(w)
    return g.select("label", "n",
                    F.when(F.col("label").isNotNull(), F.col("n") / lab_total).alias("share"),
                    (lab_total / F.sum("n").over(w)).alias("labelled_share"))


def column_moments(df: DataFrame, cols: Sequence[str], clip: dict | None = None) -> DataFrame:
    """Mean, sample std and n per numeric column (optionally clipped to
    a closed range first), as a long table."""
    clip = clip or {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        if c in clip:
            lo, hi = clip[c]
            x = F.when(x.between(lo, hi), x)
        aggs += [F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"), F.count(x).alias(f"_n{i}")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"{_sql_str(c)}, _m{i}, _s{i}, _n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, mean, std, n)")


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (or a given range), the last edge
    closed; rows outside the range are dropped. Returns (bin, lo, hi, n)."""
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull())
    if lo is not None:
        base = base.where(x.between(lo, hi))
        rng = base.agg(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    else:
        rng = base.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    lo_c, hi_c = rng.select("_lo").scalar(), rng.select("_hi").scalar()
    width = (hi_c - lo_c) / bins
    b = F.least(F.floor((x - lo_c) / width).cast("int"), F.lit(bins - 1))
    b = F.when(hi_c == lo_c, F.lit(0)).otherwise(b)
    return (base.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (lo_c + F.col("bin") * width).alias("lo"),
                    (lo_c + (F.col("bin") + 1) * width).alias("hi"), "n"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values (ties by value) — a top-k, not a sort."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)).limit(k))


def top_share(df: DataFrame, col: str, k: int) -> DataFrame:
    """Share of (non-null) rows covered by the k most frequent values."""
    top = top_values(df, col, k).agg(F.sum("n").alias("top_n"))
    tot = df.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    return top.select(F.lit(k).alias("k"), "top_n", (F.col("top_n") / tot.select("total").scalar())
                      .alias("share"))


def distribution(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max and 99 % (exact, linear)."""
    base = df.where(F.col(col).isNotNull())
    stats = base.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg(col).alias("mean"),
                                  F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
                                  F.max(col).cast("double").alias("max"))
    q = exact_quantiles(base, col, [0.25, 0.5, 0.75, 0.99], by)
    qw = q.groupBy(*by).agg(*[F.max(F.when(F.col("qi") == i, F.col("value"))).alias(n)
                             for i, n in enumerate(["p25", "p50", "p75", "p99"])])
    if by:
        return stats.join(qw, list(by))
    # both sides are single rows: fold them, no join
    names = [*stats.columns, *qw.columns]
    return stats.unionByName(qw, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def runs_per_entity(df: DataFrame, entity: str) -> DataFrame:
    """E15 on the per-entity run counts (two-level aggregation)."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("runs"))
    return distribution(per, "runs")


def by_year_drift(df: DataFrame, date: str, label: str) -> DataFrame:
    """Rows and positive rate per year plus the min / max of the rates."""
    from pyspark.sql.window import Window
    g = (df.where(F.col(label).isNotNull()).groupBy(F.year(date).alias("year"))
         .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("label_rate")))
    w = Window.partitionBy()  # one row per calendar year
    return g.select("*", F.min("label_rate").over(w).alias("rate_min"),
                    F.max("label_rate").over(w).alias("rate_max"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation on pairwise-complete rows, every ordered pair,
    one aggregate pass, unpivoted."""
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            aggs.append(F.corr(F.when(both, xa), F.when(both, xb)).alias(f"_c{i}_{j}"))
    wide = df.agg(*aggs)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            name = f"_c{min(i, j)}_{max(i, j)}"
            pairs.append(f"{_sql_str(a)}, {_sql_str(b)}, {name}")
    n = len(pairs)
    return wide.selectExpr(f"stack({n}, {', '.join(pairs)}) AS (col_a, col_b, corr)")


def rate_by_group(df: DataFrame, group: str, label: str, min_size: int) -> DataFrame:
    """Positive rate and size per group, groups with size >= min_size,
    sorted by rate desc."""
    return (df.where(F.col(label).isNotNull()).groupBy(group)
            .agg(F.avg(F.col(label).cast("double")).alias("label_rate"), F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") >= min_size).orderBy(F.col("label_rate").desc(), F.col(group)))


def bucket_rate(df: DataFrame, col: str, edges: Sequence[float], names: Sequence[str],
                label: str) -> DataFrame:
    """Left-closed bins [e_i, e_{i+1}); values outside are dropped; only
    observed bins are returned."""
    x = F.col(col)
    expr = None
    for (lo, hi), nm in zip(zip(edges[:-1], edges[1:]), names):
        cond = (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(nm)) if expr is None else expr.when(cond, F.lit(nm))
    order = None
    for i, ((lo, hi)) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x >= lo) & (x < hi)
        order = F.when(cond, F.lit(i)) if order is None else order.when(cond, F.lit(i))
    return (df.where(F.col(label).isNotNull())
            .groupBy(order.alias("bin_index"), expr.alias("bucket"))
            .agg(F.avg(F.col(label).cast("double")).alias("label_rate"), F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("bucket").isNotNull()))


def min_support(df: DataFrame, key: str, n: int) -> DataFrame:
    """Number of keys with at least ``n`` rows."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
            .agg(F.count_if(F.col("c") >= n).alias("n_keys")))


def impute_stats(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Median (exact, linear between the middle pair) per numeric column
    and most frequent value (ties -> smallest) per categorical column, as a
    long table (column_name, kind, num_value, str_value)."""
    from pyspark.sql.window import Window
    parts = []
    if numeric:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numeric
        ])).alias("_p")).select("_p.*")
        med = exact_quantiles(long, "x", [0.5], by=["column_name"])
        parts.append(med.select("column_name", F.lit("median").alias("kind"),
                                F.col("value").alias("num_value"),
                                F.lit(None).cast("string").alias("str_value")))
    for c in categorical:
        vc = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
            F.count(F.lit(1)).alias("n"))
        # most frequent; ties -> smallest value in the column's own ordering
        best = vc.agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b")))
                      .cast("string").alias("str_value"))
        parts.append(best.select(F.lit(c).alias("column_name"), F.lit("mode").alias("kind"),
                                 F.lit(None).cast("double").alias("num_value"), "str_value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
