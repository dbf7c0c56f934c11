"""Registered split, metric and profiling queries (J1-J4, E8-E25, E28, C5,
C6, C14, G5) with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import profile as P
from ..operators.split import cutoff_value, nested_split, quantile_cutoff, sample_exact, temporal_split
from ..sources.tables import HISTORY_SQL, history
from .feature_plans import KEYS, features_sql, labelled, rounded
from .registry import register

LAB_SQL = f"SELECT * FROM ({HISTORY_SQL}) r WHERE finish_pos IS NOT NULL"


def cut_sql(src: str = "lab", q: str = "0.8", col: str = "event_date") -> str:
    return (f"(SELECT min(d) FROM (SELECT d, sum(c) OVER (ORDER BY d) AS cum, sum(c) OVER () AS n "
            f"FROM (SELECT {col} AS d, count(*) AS c FROM {src} GROUP BY 1) x) y "
            f"WHERE cum > round_even(CAST(n - 1 AS DOUBLE) * CAST({q} AS DOUBLE), 0))")


# Metric binding (FIXTURES §6): a fixed logistic score of the load on labelled
# rows; part = train / test of the quantile split.
SCORED_SQL = f"""
WITH lab AS ({LAB_SQL})
SELECT contest_id, px, entity_id, event_date, label, load_kg, venue_id, distance_m,
       1.0 / (1.0 + exp((load_kg - 52) / 8.0)) AS p,
       CASE WHEN event_date < {cut_sql()} THEN 'train' ELSE 'test' END AS part
FROM lab
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = labelled(spark, sf_dir)
    c = cutoff_value(quantile_cutoff(h, 0.2))
    return h.select(*KEYS, "label", "load_kg", "venue_id", "distance_m",
                    (F.lit(1.0) / (F.lit(1.0) + F.exp((F.col("load_kg") - 52) / 8.0))).alias("p"),
                    F.when(F.col("event_date") < c, "train").otherwise("test").alias("part"))


# ---------------------------------------------------------------- splits
@register("split_quantile", f"""
WITH lab AS ({LAB_SQL}), c AS (SELECT {cut_sql()} AS cutoff)
SELECT CASE WHEN event_date < c.cutoff THEN 'train' ELSE 'test' END AS part,
       count(*) AS n_rows, min(event_date) AS date_min, max(event_date) AS date_max,
       any_value(c.cutoff) AS cutoff
FROM lab, c GROUP BY 1
""")
def _split_quantile(spark, sf_dir):
    h = labelled(spark, sf_dir)
    train, test, cut = temporal_split(h, test_size=0.2)
    c = cutoff_value(cut)
    return (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_date").alias("date_min"),
                                 F.max("event_date").alias("date_max"), F.any_value(c).alias("cutoff")))


@register("split_cutoff", f"""
WITH lab AS ({LAB_SQL})
SELECT CASE WHEN event_date < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS part,
       count(*) AS n_rows FROM lab GROUP BY 1
""")
def _split_cutoff(spark, sf_dir):
    train, test, _ = temporal_split(labelled(spark, sf_dir), cutoff="1998-01-01", strategy="cutoff")
    return (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n_rows")))


@register("split_nested", f"""
WITH lab AS ({LAB_SQL}), c AS (SELECT {cut_sql()} AS cutoff),
tr AS (SELECT lab.* FROM lab, c WHERE event_date < c.cutoff),
v AS (SELECT {cut_sql('tr')} AS vcut)
SELECT CASE WHEN lab.event_date >= c.cutoff THEN 'test'
            WHEN lab.event_date >= v.vcut THEN 'val' ELSE 'inner' END AS part,
       count(*) AS n_rows, min(lab.event_date) AS date_min, max(lab.event_date) AS date_max
FROM lab, c, v GROUP BY 1
""")
def _split_nested(spark, sf_dir):
    inner, val, test, _, _ = nested_split(labelled(spark, sf_dir), 0.2, 0.2)
    parts = (inner.withColumn("part", F.lit("inner")).unionByName(val.withColumn("part", F.lit("val")))
             .unionByName(test.withColumn("part", F.lit("test"))))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.min("event_date").alias("date_min"),
                                     F.max("event_date").alias("date_max"))


@register("sample_exact", f"""
WITH lab AS ({LAB_SQL})
SELECT contest_id, px, entity_id FROM lab
ORDER BY md5(concat_ws('|', '42', CAST(contest_id AS VARCHAR), CAST(entity_id AS VARCHAR))),
         contest_id, px
LIMIT 500
""")
def _sample_exact(spark, sf_dir):
    return sample_exact(labelled(spark, sf_dir).select("contest_id", "px", "entity_id"), 500, 42,
                        ["contest_id", "entity_id"]).select("contest_id", "px", "entity_id")


@register("drop_unlabelled", f"""
WITH r AS ({HISTORY_SQL})
SELECT count(*) AS n_all, count(*) FILTER (WHERE finish_pos IS NOT NULL) AS n_labelled,
       count(*) FILTER (WHERE label = 1) AS n_positive FROM r
""")
def _drop_unlabelled(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.agg(F.count(F.lit(1)).alias("n_all"),
                 F.count_if(F.col("finish_pos").isNotNull()).alias("n_labelled"),
                 F.count_if(F.col("label") == 1).alias("n_positive"))


@register("extract_target", f"""
WITH r AS ({HISTORY_SQL})
SELECT contest_id, px, CAST(finish_pos BETWEEN 1 AND 3 AS INTEGER) AS label
FROM r WHERE finish_pos IS NOT NULL
""")
def _extract_target(spark, sf_dir):
    from ..operators.features import label_column
    h = history(spark, sf_dir).where(F.col("finish_pos").isNotNull()).drop("label")
    return h.select("contest_id", "px", label_column(h).alias("label"))


@register("global_sort", f"""
WITH r AS ({HISTORY_SQL})
SELECT entity_id, event_date, contest_id, px FROM r ORDER BY entity_id, event_date, contest_id, px
""")
def _global_sort(spark, sf_dir):
    """Output ordering by (entity, date) — a range-partitioned sort with
    sampled boundaries, so no single task sees all rows."""
    h = history(spark, sf_dir).select("entity_id", "event_date", "contest_id", "px")
    return h.orderBy("entity_id", "event_date", "contest_id", "px")


# --------------------------------------------------------------- metrics
def _metric_reg(key, sql, fn):
    @register(key, sql)
    def _q(spark, sf_dir):
        return rounded(fn(scored(spark, sf_dir)))
    return _q


_metric_reg("binary_metrics", f"""
WITH s AS ({SCORED_SQL}),
sc AS (SELECT part, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM s GROUP BY 1, 2),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY part ORDER BY p) AS cneg,
              sum(pos) OVER (PARTITION BY part ORDER BY p) AS cpos,
              sum(pos) OVER (PARTITION BY part) AS tp_, sum(neg) OVER (PARTITION BY part) AS tn_ FROM sc),
auc AS (SELECT part, sum(pos * (cneg - neg + 0.5 * neg)) / (max(tp_) * max(tn_)) AS roc_auc,
               sum(pos * ((tp_ - cpos + pos) / (tp_ - cpos + pos + tn_ - cneg + neg))) / max(tp_) AS pr_auc
        FROM cu GROUP BY part),
m AS (SELECT part, avg((p - label) * (p - label)) AS brier,
             avg(-(label * ln(least(greatest(p, 1e-6), 1 - 1e-6))
                   + (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss,
             count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp,
             count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp,
             count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn,
             avg(CAST(label AS DOUBLE)) AS positive_rate FROM s GROUP BY part)
SELECT m.part, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_at_05,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE 1.0 * tp / (tp + fp) END, 6) AS precision_at_05,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE 1.0 * tp / (tp + fn) END, 6) AS recall_at_05,
       round(positive_rate, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
FROM m JOIN auc ON m.part = auc.part
""", lambda s: M.binary_metrics(s, "label", "p", 0.5, by=["part"]))

_metric_reg("roc_auc", f"""
WITH s AS ({SCORED_SQL}),
sc AS (SELECT part, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM s GROUP BY 1, 2),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY part ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
                                          AND 1 PRECEDING), 0) AS below FROM sc)
SELECT part, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc
FROM cu GROUP BY part
""", lambda s: M.roc_auc(s, "label", "p", by=["part"]))

_metric_reg("average_precision", f"""
WITH s AS ({SCORED_SQL}),
sc AS (SELECT part, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM s GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY part ORDER BY p DESC) AS tp,
              sum(neg) OVER (PARTITION BY part ORDER BY p DESC) AS fp,
              sum(pos) OVER (PARTITION BY part) AS ptot FROM sc)
SELECT part, round(sum(pos * tp / (tp + fp)) / max(ptot), 6) AS pr_auc FROM cu GROUP BY part
""", lambda s: M.average_precision(s, "label", "p", by=["part"]))

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
_TH_SQL = "[" + ", ".join(f"CAST({t} AS DOUBLE)" for t in THRESHOLDS) + "]"
_metric_reg("threshold_sweep", f"""
WITH s AS ({SCORED_SQL}), th AS (SELECT unnest({_TH_SQL}) AS threshold),
tot AS (SELECT part, count(*) FILTER (WHERE label = 1) AS P, count(*) AS N FROM s GROUP BY part)
SELECT tot.part, th.threshold,
       CAST(count(s.p) AS BIGINT) AS n_pred, CAST(count(s.p) FILTER (WHERE s.label = 1) AS BIGINT) AS tp,
       round(CASE WHEN count(s.p) = 0 THEN 0 ELSE count(s.p) FILTER (WHERE s.label = 1) * 1.0 / count(s.p) END, 6)
         AS precision,
       round(CASE WHEN max(tot.P) = 0 THEN 0 ELSE count(s.p) FILTER (WHERE s.label = 1) * 1.0 / max(tot.P) END, 6)
         AS recall,
       round(CASE WHEN count(s.p) = 0 THEN 0 ELSE count(s.p) FILTER (WHERE s.label = 1) * 1.0 / count(s.p) END
             / (max(tot.P) * 1.0 / max(tot.N)), 6) AS lift
FROM tot CROSS JOIN th LEFT JOIN s ON s.part = tot.part AND s.p >= th.threshold
GROUP BY tot.part, th.threshold
""", lambda s: M.threshold_sweep(s, "label", "p", THRESHOLDS, by=["part"]))

_metric_reg("calibration_bins", f"""
WITH s AS ({SCORED_SQL}),
e AS (SELECT part, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM s GROUP BY part),
b AS (SELECT s.part, len(list_filter(e.edges, lambda x: x <= s.p)) AS bin, s.p, s.label
      FROM s JOIN e ON s.part = e.part)
SELECT part, bin, count(*) AS n, round(avg(p), 6) AS pred_mean, round(avg(CAST(label AS DOUBLE)), 6) AS obs_rate,
       round(avg(CAST(label AS DOUBLE)) - avg(p), 6) AS gap
FROM b GROUP BY part, bin
""", lambda s: M.calibration_bins(s, "label", "p", 10, by=["part"]))

_metric_reg("range_clip", f"""
WITH s AS ({SCORED_SQL})
SELECT contest_id, px, round(least(greatest(p, 1e-6), 1 - 1e-6), 6) AS p_clipped,
       load_kg BETWEEN 40 AND 70 AS kg_in_range FROM s
""", lambda s: s.select("contest_id", "px", F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
                       .alias("p_clipped"), F.col("load_kg").between(40, 70).alias("kg_in_range")))


# --------------------------------------------------------------- profiling
def _prof_reg(key, sql, fn, src="history"):
    @register(key, sql)
    def _q(spark, sf_dir):
        h = history(spark, sf_dir)
        return rounded(fn(h))
    return _q


_prof_reg("profile_summary", f"""
WITH r AS ({HISTORY_SQL})
SELECT count(*) AS n_rows, CAST(14 AS BIGINT) AS n_cols, count(DISTINCT entity_id) AS n_entities,
       count(DISTINCT rider_id) AS n_riders, count(DISTINCT venue_id) AS n_venues,
       min(event_date) AS date_min, max(event_date) AS date_max,
       round(datediff('day', min(event_date), max(event_date)) / 365.25, 6) AS span_years
FROM r
""", lambda h: P.profile_summary(h, "entity_id", "rider_id", "venue_id", "event_date"))

_NP_TYPES = [("entity_id", "bigint"), ("rider_id", "bigint"), ("contest_id", "bigint"), ("px", "double"),
             ("event_date", "date"), ("venue_id", "int"), ("distance_m", "int"), ("load_kg", "double"),
             ("finish_pos", "int"), ("dividend", "double"), ("label", "int"), ("sex_code", "string"),
             ("horse_age", "int"), ("post_position", "int")]
_prof_reg("null_profile", f"""
WITH r AS ({HISTORY_SQL}), n AS (SELECT count(*) AS n FROM r)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_pct FROM r"
    for c, t in _NP_TYPES), P.null_profile)

_prof_reg("class_balance", f"""
WITH r AS ({HISTORY_SQL}), g AS (SELECT label, count(*) AS n FROM r GROUP BY label)
SELECT label, n, round(CASE WHEN label IS NOT NULL THEN n * 1.0 / sum(n) FILTER (WHERE label IS NOT NULL) OVER () END, 6)
         AS share,
       round(sum(n) FILTER (WHERE label IS NOT NULL) OVER () * 1.0 / sum(n) OVER (), 6) AS labelled_share
FROM g
""", lambda h: P.class_balance(h, "label"))

_MOM = ["load_kg", "distance_m", "px", "dividend", "finish_pos"]
_prof_reg("column_moments", f"""
WITH r AS ({LAB_SQL})
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
    f"count({x}) AS n FROM r"
    for c, x in [(c, f"CASE WHEN {c} BETWEEN 40 AND 70 THEN CAST({c} AS DOUBLE) END" if c == "load_kg"
                  else f"CAST({c} AS DOUBLE)") for c in _MOM]),
    lambda h: P.column_moments(h.where(F.col("finish_pos").isNotNull()), _MOM, clip={"load_kg": (40, 70)}))

_prof_reg("histogram", f"""
WITH r AS ({LAB_SQL}), x AS (SELECT CAST(load_kg AS DOUBLE) AS v FROM r WHERE load_kg BETWEEN 40 AND 70)
SELECT CAST(least(floor((v - 40.0) / 0.75), 39) AS INTEGER) AS bin,
       round(40.0 + least(floor((v - 40.0) / 0.75), 39) * 0.75, 6) AS lo,
       round(40.0 + (least(floor((v - 40.0) / 0.75), 39) + 1) * 0.75, 6) AS hi, count(*) AS n
FROM x GROUP BY 1, 2, 3
""", lambda h: P.histogram(h.where(F.col("finish_pos").isNotNull()), "load_kg", 40, 40.0, 70.0))

_prof_reg("top_values", f"""
WITH r AS ({LAB_SQL})
SELECT rider_id, count(*) AS n FROM r GROUP BY rider_id ORDER BY n DESC, rider_id LIMIT 15
""", lambda h: P.top_values(h.where(F.col("finish_pos").isNotNull()), "rider_id", 15))

_prof_reg("top_share", f"""
WITH r AS ({LAB_SQL}), t AS (SELECT rider_id, count(*) AS n FROM r GROUP BY rider_id ORDER BY n DESC, rider_id LIMIT 15)
SELECT 15 AS k, sum(n) AS top_n, round(sum(n) * 1.0 / (SELECT count(*) FROM r WHERE rider_id IS NOT NULL), 6) AS share
FROM t
""", lambda h: P.top_share(h.where(F.col("finish_pos").isNotNull()), "rider_id", 15))

_prof_reg("runs_per_entity", f"""
WITH r AS ({HISTORY_SQL}), per AS (SELECT entity_id, count(*) AS runs FROM r GROUP BY entity_id)
SELECT count(*) AS count, round(avg(runs), 6) AS mean, round(stddev_samp(runs), 6) AS std,
       CAST(min(runs) AS DOUBLE) AS min, CAST(max(runs) AS DOUBLE) AS max,
       round(quantile_cont(runs, 0.25), 6) AS p25, round(quantile_cont(runs, 0.5), 6) AS p50,
       round(quantile_cont(runs, 0.75), 6) AS p75, round(quantile_cont(runs, 0.99), 6) AS p99
FROM per
""", lambda h: P.runs_per_entity(h, "entity_id"))

_prof_reg("by_year_drift", f"""
WITH r AS ({LAB_SQL}),
g AS (SELECT year(event_date) AS year, count(*) AS n_rows, avg(CAST(label AS DOUBLE)) AS label_rate
      FROM r GROUP BY 1)
SELECT year, n_rows, round(label_rate, 6) AS label_rate, round(min(label_rate) OVER (), 6) AS rate_min,
       round(max(label_rate) OVER (), 6) AS rate_max FROM g
""", lambda h: P.by_year_drift(h, "event_date", "label"))

_CORR = ["load_kg", "distance_m", "px", "dividend", "finish_pos", "label"]
_prof_reg("correlation_matrix", f"""
WITH r AS ({LAB_SQL})
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM r"
    for a in _CORR for b in _CORR),
    lambda h: P.correlation_matrix(h.where(F.col("finish_pos").isNotNull()), _CORR))

_prof_reg("rate_by_group", f"""
WITH r AS ({LAB_SQL})
SELECT venue_id, round(avg(CAST(label AS DOUBLE)), 6) AS label_rate, count(*) AS n_rows
FROM r GROUP BY venue_id HAVING count(*) >= 500
""", lambda h: P.rate_by_group(h, "venue_id", "label", 500))

# --- fixed values: distance bins of the profiling report (left-closed) --------
DIST_EDGES = [0, 1100, 1300, 1500, 1700, 2100, 4000]
DIST_NAMES = ["<1100", "1100-1299", "1300-1499", "1500-1699", "1700-2099", "≥2100"]
# --- end of fixed values -----------------------------------------------------
_BUCKET_CASE = " ".join(f"WHEN distance_m >= {lo} AND distance_m < {hi} THEN {i}"
                        for i, (lo, hi) in enumerate(zip(DIST_EDGES[:-1], DIST_EDGES[1:])))
_prof_reg("bucket_rate", f"""
WITH r AS ({LAB_SQL}), b AS (SELECT CASE {_BUCKET_CASE} END AS bin_index, label FROM r)
SELECT bin_index, ['{"', '".join(DIST_NAMES)}'][bin_index + 1] AS bucket,
       round(avg(CAST(label AS DOUBLE)), 6) AS label_rate, count(*) AS n_rows
FROM b WHERE bin_index IS NOT NULL GROUP BY bin_index
""", lambda h: P.bucket_rate(h, "distance_m", DIST_EDGES, DIST_NAMES, "label"))

_prof_reg("min_support", f"""
WITH r AS ({LAB_SQL}), g AS (SELECT rider_id, count(*) AS c FROM r GROUP BY rider_id)
SELECT count(*) FILTER (WHERE c >= 10) AS n_keys FROM g
""", lambda h: P.min_support(h.where(F.col("finish_pos").isNotNull()), "rider_id", 10))


# Imputation statistics fitted on the training slice of the features.
_NUMERIC_FOR_IMPUTE = ["weight_kg", "weight_kg_zscore_in_race", "rest_days", "career_runs",
                       "career_win_rate", "career_show_rate", "year_runs", "last_finish_pos",
                       "avg_finish_last3", "track_show_rate", "dist_bucket_show_rate",
                       "days_since_last_win", "dividend_career_mean", "dividend_last3_mean",
                       "jockey_career_show_rate", "horse_age", "post_position"]


@register("impute_stats", f"""
WITH f AS ({features_sql('train')}), lab AS ({LAB_SQL}),
tr AS (SELECT * FROM f WHERE event_date < {cut_sql()})
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'median' AS kind, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS num_value, "
    f"CAST(NULL AS VARCHAR) AS str_value FROM tr HAVING count({c}) > 0" for c in _NUMERIC_FOR_IMPUTE)
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'mode' AS kind, CAST(NULL AS DOUBLE) AS num_value, "
    f"CAST((SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS VARCHAR) "
    f"AS str_value" for c in ["sex_code", "racetrack_id"]))
def _impute_stats(spark, sf_dir):
    from .selection_plans import train_slice
    return rounded(P.impute_stats(train_slice(spark, sf_dir), _NUMERIC_FOR_IMPUTE, ["sex_code", "racetrack_id"]))
