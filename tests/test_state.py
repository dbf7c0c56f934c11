"""The kept state and the reduced history against the general operator; the lookback against a literal join."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pastcast.operators.asof import only_keys
from pastcast.operators.features import history_rows, point_in_time_features
from pastcast.operators.state import keep_state
from pastcast.schema import ALL_FEATURES

RUNS = ("entity_id string, rider_id string, event_date date, venue_id int, finish_pos int, load_kg double, distance_m int, "
        "dividend double, contest_id bigint, px double")
DAY0 = dt.date(2023, 6, 1)


def runs(seed, n=1500, first=0, days=700, names=25):
    """Runs with ties within a day, nulls in every optional column, and one entity with a third of all rows."""
    rng, out = random.Random(seed), []
    maybe = lambda v, p=.08: None if rng.random() < p else v
    for i in range(n):
        name = "HOT" if rng.random() < 1 / 3 else f"E{rng.randrange(names)}"
        out.append((maybe(name, .02), maybe(f"R{rng.randrange(9)}"), DAY0 + dt.timedelta(days=first + rng.randrange(days)), maybe(rng.randrange(4)),
                    maybe(rng.randrange(1, 9), .15), maybe(float(rng.randrange(45, 65))), maybe(rng.choice([1000, 1050, 1100, 1101, 1200, 1399])),
                    maybe(round(rng.random() * 20, 1), .4), i // 7, float(i)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    history = spark.createDataFrame(runs(1), RUNS).cache()
    targets = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in runs(2, 300, 700, 40, 40)], RUNS).cache()
    return history, targets


def as_rows(df):
    cols = ["contest_id", "px", *ALL_FEATURES]
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(near(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def test_reduced_history_changes_nothing(spark, tables):
    history, targets = tables
    few = targets.where("entity_id IN ('E1', 'E39') OR rider_id = 'R3'")
    assert as_rows(point_in_time_features(history, few, reduce_history=True)) == as_rows(point_in_time_features(history, few))


def test_history_is_cut_before_any_shuffle(spark, tables):
    history, targets = tables
    few = targets.where("entity_id = 'E1'")
    rows = history_rows(history)
    kept = only_keys(rows, "_e", few, "entity_id")
    assert 0 < kept.count() == rows.where("_e = 'E1'").count() < rows.count() / 10
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and plan.count("Exchange hashpartitioning(_e") <= 1  # the distinct keys
    many = only_keys(rows, "_e", targets, "entity_id", sent_keys=3)  # too many to send: the same rows by a shuffle
    assert sorted(map(repr, many.collect())) == sorted(map(repr, only_keys(rows, "_e", targets, "entity_id").collect()))
    assert only_keys(rows, "_e", targets.limit(0), "entity_id").count() == 0


def test_kept_state_equals_the_general_operator_over_three_batches(spark, tables, tmp_path):
    history, targets = tables
    kept = keep_state(history, DAY0 + dt.timedelta(days=700), str(tmp_path), buckets=4, salt_buckets=3)
    frozen = history.where(F.col("event_date") < DAY0 + dt.timedelta(days=700))
    for i in range(3):
        batch = targets.where(F.col("contest_id") % 3 == i)
        assert as_rows(kept.score_rows(spark, batch)) == as_rows(point_in_time_features(frozen, batch))
        assert as_rows(kept.score_rows(spark, batch, ["contest_id"])) == as_rows(point_in_time_features(frozen, batch, contest_cols=["contest_id"]))
    assert kept.score_rows(spark, targets.limit(0)).count() == 0


def test_a_batch_neither_aggregates_nor_shuffles_the_state(spark, tables, tmp_path):
    history, targets = tables
    kept = keep_state(history, DAY0 + dt.timedelta(days=700), str(tmp_path), buckets=4)
    values = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        plan = kept.score_rows(spark, targets).drop("weight_kg_zscore_in_race", "n_field")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        if "FileScan parquet" in line and "kept_" in line:
            assert "Bucketed: true" in line
            indent = lambda x: len(re.match("[ :+-]*", x).group())
            depth, above = indent(line), []
            for upper in reversed(lines[:at]):  # the nodes on the way to the root
                if indent(upper) < depth:
                    depth = indent(upper)
                    above.append(upper)
            below_join = above[:next(i for i, x in enumerate(above) if "Join" in x)]
            assert not any("Exchange" in x or "Aggregate" in x for x in below_join), below_join


def test_targets_before_the_frozen_day_are_refused(spark, tables, tmp_path):
    history, targets = tables
    kept = keep_state(history, DAY0 + dt.timedelta(days=710), str(tmp_path))
    with pytest.raises(Exception, match="younger than a target"):
        kept.score_rows(spark, targets).collect()


@pytest.mark.parametrize("lookback", [1, 7, 60, 400])
def test_lookback_against_a_literal_join(spark, tables, lookback):
    history, targets = tables
    both = targets.unionByName(history.where("contest_id % 3 = 0"))
    got = {(r.contest_id, r.px, r.event_date): r for r in point_in_time_features(history, both, lookback_days=lookback, groups={"entity", "venue", "band"}).collect()}
    past = [r for r in history.collect() if r.finish_pos is not None and r.entity_id is not None]
    for t in both.collect():
        r = got[t.contest_id, t.px, t.event_date]
        h = [x for x in past if x.entity_id == t.entity_id and t.event_date - dt.timedelta(days=lookback) <= x.event_date < t.event_date]
        same = [x for x in h if x.event_date.year == t.event_date.year]
        paid = [x.dividend for x in h if x.dividend is not None]
        wins = [x.event_date for x in h if x.finish_pos == 1]
        assert (r.career_runs, r.career_wins, r.year_runs) == (len(h), len(wins), len(same))
        assert r.dividend_career_min == (min(paid) if paid else None)
        assert (r.dividend_career_mean is None) == (not paid) and (not paid or abs(r.dividend_career_mean - sum(paid) / len(paid)) < 1e-9)
        assert r.days_since_last_win == ((t.event_date - max(wins)).days if wins else None)
        assert r.track_runs == sum(t.venue_id is not None and x.venue_id == t.venue_id for x in h)
        assert r.dist_bucket_runs == sum(t.distance_m is not None and x.distance_m is not None and abs(x.distance_m - t.distance_m) <= 100 for x in h)


def _odd_runs(spark, entities, n, days):
    """Runs with missing keys, days, places and dividends, several a day, before and after 1970, some of them twice."""
    i = F.col("id")
    h = lambda s, m: F.pmod(F.xxhash64(i, F.lit(s)), F.lit(m))
    rows = spark.range(n).select(
        F.when(h(1, 97) > 0, F.least(h(14, 2 * entities), F.lit(entities))).alias("entity_id"), (i % 50).alias("rider_id"), F.floor(i / 7).alias("contest_id"),
        h(2, 5).cast("double").alias("px"), F.when(h(3, 101) > 0, F.date_add(F.lit(dt.date(1969, 9, 1)), h(4, days).cast("int"))).alias("event_date"),
        F.when(h(5, 6) > 0, h(5, 6)).cast("int").alias("venue_id"), F.when(h(6, 31) > 0, 1000 + h(7, 13) * 50).cast("int").alias("distance_m"),
        F.when(h(8, 29) > 0, 40 + h(9, 50) * 0.5).cast("double").alias("load_kg"), F.when(h(10, 9) > 0, 1 + h(11, 8)).cast("int").alias("finish_pos"),
        F.when(h(12, 3) > 0, h(13, 90)).cast("double").alias("dividend"))
    return rows.unionByName(rows.where("contest_id % 9 = 0"))


@pytest.mark.parametrize("lookback", [1, 60, 1000])
def test_lookback_of_short_and_long_histories(spark, monkeypatch, lookback):
    """Rows met by the days that see them, and running sums, give the same; half the rows are of one entity."""
    from pastcast.operators import features
    rows = _odd_runs(spark, 20, 1500, 400).cache()

    def got(frame_rows):
        monkeypatch.setattr(features, "FRAME_ROWS", frame_rows)
        df = point_in_time_features(rows, rows, lookback_days=lookback, last_n=4)
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    running = got(0)
    assert len(running) == rows.count() and running == got(300) and running == got(100_000)


def test_lookback_of_runs_that_tie(spark, monkeypatch):
    """Five rows of one contest and tie-break on the last day: of ties, the three that come first in the contest count."""
    from pastcast.operators import features
    past = [("X", "r", dt.date(2024, 1, d), 1, pos, 50.0, 1600, float(pos), c, 1.0) for d, pos, c in
            [(2, 9, 1), (9, 1, 2), (9, 2, 2), (9, 3, 2), (9, 4, 2), (9, 5, 2)]]
    rows = spark.createDataFrame(past, RUNS).coalesce(1)
    target = spark.createDataFrame([("X", "r", dt.date(2024, 1, 20), 1, None, 50.0, 1600, None, 3, 1.0)], RUNS)
    got = []
    for n in (0, 300):
        monkeypatch.setattr(features, "FRAME_ROWS", n)
        got.append(point_in_time_features(rows, target, lookback_days=30).first())
    assert got[0] == got[1] and (got[1].avg_finish_last3, got[1].best_finish_last3, got[1].dividend_last3_mean, got[1].career_runs) == (2, 1, 2, 6)


def test_lookback_of_short_histories_runs_no_window(spark):
    rows = _odd_runs(spark, 100, 800, 400).where("entity_id < 100")
    df = point_in_time_features(rows, rows, lookback_days=60, groups={"entity", "venue", "band"})
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert "Join" in final and "Window" not in final
