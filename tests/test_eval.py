"""Split, metric and selection edge cases against brute force."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pastcast.operators import metrics as M
from pastcast.operators.ranking import exact_quantiles
from pastcast.operators.split import quantile_cutoff, temporal_split


def _days(spark, n):
    return spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(n)], "event_date DATE")


@pytest.mark.parametrize("n,idx", [(5, 2), (6, 2), (7, 3)])
def test_quantile_cutoff_half_to_even(spark, n, idx):
    c = quantile_cutoff(_days(spark, n), 0.5).collect()[0].cutoff
    assert c == dt.date(2024, 1, 1) + dt.timedelta(days=idx)


def test_all_rows_one_day_gives_empty_train(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)] * 4, "event_date DATE")
    train, test, _ = temporal_split(df, test_size=0.2)
    assert train.count() == 0 and test.count() == 4


def test_split_rejects_bad_arguments(spark):
    with pytest.raises(ValueError):
        temporal_split(_days(spark, 3), strategy="other")
    with pytest.raises(ValueError):
        temporal_split(_days(spark, 3), strategy="cutoff")
    with pytest.raises(ValueError):
        quantile_cutoff(_days(spark, 3), 1.5)


def _brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(ys, ps):
    P = sum(ys)
    out = 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        pos_here = sum(1 for y, p in zip(ys, ps) if p == t and y == 1)
        out += pos_here / P * tp / (tp + fp)
    return out


def test_auc_ap_with_ties_match_brute_force(spark):
    rnd = random.Random(7)
    ys = [rnd.randint(0, 1) for _ in range(300)]
    ps = [round(rnd.random(), 1) for _ in range(300)]          # heavy ties
    df = spark.createDataFrame(list(zip(ys, ps)), "label INT, p DOUBLE")
    auc = M.roc_auc(df, "label", "p").collect()[0].roc_auc
    ap = M.average_precision(df, "label", "p").collect()[0].pr_auc
    assert auc == pytest.approx(_brute_auc(ys, ps), abs=1e-12)
    assert ap == pytest.approx(_brute_ap(ys, ps), abs=1e-12)
    # prefix sums must not depend on the bucket count
    for b in (1, 3, 50):
        from pastcast.operators.ranking import global_prefix
        g = global_prefix(M.score_table(df, "label", "p"), "_s", ["neg"], buckets=b)
        got = g.groupBy().agg((F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg")))
                               / (F.sum("pos") * F.max("tot_neg"))).alias("a")).collect()[0].a
        assert got == pytest.approx(auc, abs=1e-12)


def test_threshold_metrics_zero_division_and_clip(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.2), (1, 1.0)], "label INT, p DOUBLE")
    r = M.threshold_metrics(df, "label", "p", 2.0).collect()[0]     # no predicted positives
    assert r.precision_at_05 == 0.0 and r.recall_at_05 == 0.0 and r.f1_at_05 == 0.0
    assert math.isfinite(r.log_loss)


def test_exact_quantiles_linear(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    q = {round(r.q, 2): r.value for r in exact_quantiles(df, "x", [0.1, 0.5, 0.99]).collect()}
    s = sorted(vals)

    def lin(p):
        h = (len(s) - 1) * p
        lo = math.floor(h)
        hi = min(lo + 1, len(s) - 1)
        return s[lo] + (h - lo) * (s[hi] - s[lo])
    for p in (0.1, 0.5, 0.99):
        assert q[p] == pytest.approx(lin(p))
