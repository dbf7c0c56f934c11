"""Exact binary-classification metrics as aggregates.

Everything is computed from a (group, score) -> (pos, neg) table, so the row
data is reduced by a partial aggregation first; orderings over scores use the
bucketed prefix sums of ``ranking.global_prefix`` (no single-task sort).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles, global_prefix

# --- fixed values: log-loss probability clip ---------------------------------
EPS = 1e-6
# --- end of fixed values -----------------------------------------------------


def _zero_div(num: Column, den: Column) -> Column:
    """x / y with 0 when y == 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def _grouped(df: DataFrame, by: Sequence[str]):
    """A single-group computation still joins on a (constant) key column."""
    if by:
        return df, list(by)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of both per group; without groups both are one row, folded without a join."""
    if by:
        return a.join(b, list(by))
    return a.unionByName(b, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in [*a.columns, *b.columns]])


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label)
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(*by, F.col(score).cast("double").alias("_s"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def _auc_of() -> Column:
    below = F.col("cum_neg") - F.col("neg")
    return (F.sum(F.col("pos") * (below + 0.5 * F.col("neg")))
            / (F.sum("pos").cast("double") * F.max("tot_neg").cast("double"))).alias("roc_auc")


def _ap_of() -> Column:
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return (F.sum(F.col("pos") * tp / (tp + fp)) / F.max("tot_pos")).alias("pr_auc")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with tie correction (= Mann-Whitney U / (P*N))."""
    g = global_prefix(score_table(df, label, score, by), "_s", ["neg"], by)
    return g.groupBy(*by).agg(_auc_of())


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise AP = sum_s (pos_s / P) * precision(score >= s).
    (Not Spark's trapezoidal ``areaUnderPR``.)"""
    g = global_prefix(score_table(df, label, score, by), "_s", ["pos", "neg"], by)
    return g.groupBy(*by).agg(_ap_of())


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                      by: Sequence[str] = ()) -> DataFrame:
    """E21 (the aggregate part): Brier, log-loss (clipped), F1 / precision /
    recall at ``score >= threshold`` with 0 for 0/0, positive rate."""
    y = F.col(label).cast("double")
    p = F.col(score).cast("double")
    pc = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    pred = p >= threshold
    tp = F.count_if(pred & (y == 1))
    fp = F.count_if(pred & (y == 0))
    fn = F.count_if(~pred & (y == 1))
    return (df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss"),
        tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"),
        F.avg(y).alias("positive_rate"))
        .select(*by, "brier", "log_loss",
                _zero_div(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1_at_05"),
                _zero_div(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision_at_05"),
                _zero_div(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall_at_05"),
                "positive_rate"))


def binary_metrics(df: DataFrame, label: str = "label", score: str = "p", threshold: float = 0.5,
                   by: Sequence[str] = ()) -> DataFrame:
    """The eight metrics of a run, one row per group."""
    # one ordered pass serves both rank metrics
    g = global_prefix(score_table(df, label, score, by), "_s", ["pos", "neg"], by)
    return _beside(threshold_metrics(df, label, score, threshold, by), g.groupBy(*by).agg(_auc_of(), _ap_of()), by)


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and lift over the base rate at each threshold.
    Rows are reduced to (band, label) counts, where band = number of
    thresholds <= score; cumulative band sums give every threshold at once."""
    ths = F.array(*[F.lit(float(t)) for t in thresholds])
    s = F.col(score).cast("double")
    out_by = list(by)
    df, by = _grouped(df, by)
    banded = (df.where(F.col(label).isNotNull() & s.isNotNull())
              .groupBy(*by, F.size(F.filter(ths, lambda t: t <= s)).alias("band"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n")))
    idx = banded.sparkSession.range(1, len(thresholds) + 1).select(
        F.col("id").cast("int").alias("ti"))
    # threshold i counts the rows whose band >= i (bands <= #thresholds + 1 rows)
    grid = banded.join(F.broadcast(idx), F.col("band") >= F.col("ti"))
    tot = banded.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("n").alias("N"))
    agg = grid.groupBy(*by, "ti").agg(F.sum("pos").alias("tp"), F.sum("n").alias("n_pred"))
    full = tot.select(*by, "P", "N", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds))))
                      .alias("ti"))
    res = full.join(agg, [*by, "ti"], "left").fillna(0, ["tp", "n_pred"])
    prec = _zero_div(F.col("tp"), F.col("n_pred"))
    return res.select(
        *out_by, F.element_at(ths, F.col("ti")).alias("threshold"),
        F.col("n_pred").cast("long").alias("n_pred"), F.col("tp").cast("long").alias("tp"),
        prec.alias("precision"), _zero_div(F.col("tp"), F.col("P")).alias("recall"),
        (prec / (F.col("P") / F.col("N"))).alias("lift"))


def calibration_bins(df: DataFrame, label: str, score: str, n_bins: int = 10,
                     by: Sequence[str] = ()) -> DataFrame:
    """Quantile bins (exact edges, linear interpolation); bin = number of
    inner edges <= score; per non-empty bin mean prediction, observed rate,
    gap = observed - predicted."""
    probs = [i / n_bins for i in range(1, n_bins)]
    out_by = list(by)
    q = exact_quantiles(df, score, probs, by)
    edges = q.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("qi", "value"))).alias("_e"))
    edges = edges.select(*by, F.transform("_e", lambda x: x["value"]).alias("_edges"))
    s = F.col(score).cast("double")
    base = df.where(F.col(label).isNotNull() & s.isNotNull())
    joined = base.join(edges, list(by)) if by else base.withColumn("_edges", edges.select("_edges").scalar())
    return (joined.groupBy(*out_by, F.size(F.filter("_edges", lambda e: e <= s)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("pred_mean"),
                 F.avg(F.col(label).cast("double")).alias("obs_rate"))
            .withColumn("gap", F.col("obs_rate") - F.col("pred_mean")))
