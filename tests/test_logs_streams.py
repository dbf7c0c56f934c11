"""The stored run log, the parameter search on it, the append-mode stream, selection statistics by counting."""
import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pastcast.ml import model as ML
from pastcast.ml import search as SEARCH
from pastcast.operators import selection as SEL
from pastcast.operators.features import event_ordinal
from pastcast.sources.runlog import RunLog
from pastcast.streaming import jobs as J


def test_run_log_appends_and_never_twice(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log")
    assert log.read().count() == 0
    wide = spark.createDataFrame([(0.7, 0.5)], "roc_auc double, log_loss double")
    assert log.append("search", {"trials": 2, "space": "wide"})
    assert log.append("trial-1", {"depth": 6}, wide, parent="search")
    before = sorted(map(str, log.read().collect()))
    assert not log.append("trial-1", {"depth": 7}, wide, parent="search")  # a replay
    assert sorted(map(str, log.read().collect())) == before
    assert RunLog(spark, f"{tmp_path}/log").append("trial-2", {}, wide.limit(1), parent="search")  # a second run appends
    rows = log.read().collect()
    assert len(rows) == len(before) + 3
    assert {(r.key, r.value, r.text) for r in rows if r.run_id == "search"} == {("trials", 2.0, "2"), ("space", None, "wide")}
    assert {(r.key, r.value) for r in rows if r.run_id == "trial-1" and r.kind == "metric"} == {("roc_auc", 0.7), ("log_loss", 0.5)}
    assert {r.parent_run_id for r in rows if r.run_id.startswith("trial")} == {"search"}
    with pytest.raises(ValueError):
        log.append("../x")


def test_search_eliminates_stops_and_resumes(spark, tmp_path, monkeypatch):
    df = spark.range(900).select(F.col("id"), (F.rand(1) * 4).alias("a"), F.rand(2).alias("b"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"))
    df = df.withColumn("label", (F.col("a") + F.rand(3) > 2.5).cast("int")).cache()
    train, val = df.where("id % 3 < 2"), df.where("id % 3 = 2")
    trials = [{"maxIter": 9, "maxDepth": d, "stepSize": s, "seed": 1} for d, s in ((1, 0.01), (3, 0.2), (2, 0.1))]
    log = RunLog(spark, f"{tmp_path}/log")
    fits, fit = [], SEARCH.fit_stopped
    monkeypatch.setattr(SEARCH, "fit_stopped", lambda *a: fits.append(a[4]) or fit(*a))
    best, params = SEARCH.search(log, "s", trials, train, val, ["a", "b"], ["c"], shares=(1 / 3, 1.0), at_once=2)
    assert params == trials[best] and sorted(p["maxIter"] for p in fits) == [3, 3, 3, 9]  # three trials, then the best one
    rows = log.read().collect()
    assert {r.run_id for r in rows} == {"s", "s-round0-trial0", "s-round0-trial1", "s-round0-trial2", f"s-round1-trial{best}"}
    scores = {r.run_id: r.value for r in rows if r.key == SEARCH.METRIC}
    assert scores[f"s-round0-trial{best}"] == max(v for k, v in scores.items() if "round0" in k)
    assert SEARCH.search(log, "s", trials, train, val, ["a", "b"], ["c"], shares=(1 / 3, 1.0)) == (best, params)
    assert len(fits) == 4  # nothing is fitted again
    # validation rows stop a fit that no longer gains
    noise = df.withColumn("label", (F.rand(9) > 0.5).cast("int")).cache()
    stopped = fit(noise.where("id % 3 < 2"), noise.where("id % 3 = 2"), ["a", "b"], ["c"], {"maxIter": 30, "maxDepth": 4, "stepSize": 0.5})
    assert stopped.stages[-1].getNumTrees < 30


def test_search_without_a_tolerance_fits_all_trees(spark, tmp_path):
    noise = spark.range(300).select("id", (F.rand(1) * 4).alias("a"), F.rand(2).alias("b"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"),
                                    (F.rand(9) > 0.5).cast("int").alias("label")).cache()
    train, val = noise.where("id % 3 < 2"), noise.where("id % 3 = 2")
    log = RunLog(spark, f"{tmp_path}/log")
    trials = [{"maxIter": n, "maxDepth": 3, "stepSize": 0.5, "seed": 1} for n in (9, 12)]
    best, _ = SEARCH.search(log, "s", trials, train, val, ["a", "b"], ["c"], shares=(1.0,), tol=None)
    rows = log.read().where("kind = 'metric'").collect()
    assert {r.run_id: r.value for r in rows if r.key == "trees_kept"} == {"s-round0-trial0": 9, "s-round0-trial1": 12}
    scores = {r.run_id: r.value for r in rows if r.key == SEARCH.METRIC}
    assert scores[f"s-round0-trial{best}"] == max(scores.values())


def test_search_params_fits_every_trial_whole(spark, tmp_path, monkeypatch):
    """50 trials, each once and with all the trees it sampled, and the best one again on the train slice."""
    from pastcast.plans import ml_plans
    rows = spark.range(60).select(F.col("id").alias("contest_id"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("event_date"),
                                  (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("career_runs"),
                                  F.lit("M").alias("sex_code"), F.lit("1").alias("racetrack_id"))
    fits, refits, fit = [], [], SEARCH.fit_stopped
    monkeypatch.setattr(ml_plans, "labelled", lambda *a: rows)
    monkeypatch.setattr(ml_plans, "_prepared", lambda *a: (rows, rows, ["career_runs"]))
    monkeypatch.setattr(ml_plans, "_split_tables", lambda *a: (rows, rows))
    monkeypatch.setattr(ml_plans, "source_key", lambda *a: "key")
    monkeypatch.setattr(ml_plans, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    small = {}

    def fitted(train, val, num, cat, params, label, tol):
        fits.append((params, tol))
        if not small:  # one model, of one tree, is enough to rank
            small["model"] = fit(train, val, num, cat, {**params, "maxIter": 1}, label, tol)
        return small["model"]
    whole = ml_plans.ML.train_eval
    monkeypatch.setattr(SEARCH, "fit_stopped", fitted)
    monkeypatch.setattr(ml_plans.ML, "train_eval", lambda tr, te, num, cat, params: refits.append(params) or whole(tr, te, num, cat, {**params, "maxIter": 1}))
    got = ml_plans._search_params(spark, "no folder").collect()
    sampled = [dict(t, seed=42) for t in ML.sample_params(50, seed=42)]
    assert sorted(map(str, (p for p, _ in fits))) == sorted(map(str, sampled)) and {tol for _, tol in fits} == {None}
    assert min(p["maxIter"] for p in sampled) >= 200 and len({p["maxIter"] for p in sampled}) > 40
    assert refits == [sampled[got[0].best_trial]] and {r.part for r in got} == {"train", "test"}


def test_days_are_emitted_once_late_rows_dropped_over_restarts(spark, tmp_path):
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    runs = [[(day(1), "x"), (day(2), "p"), (day(3), "x")],
            [(day(2), "p"), (day(1), "p"), (day(5), "x"), (day(3, 0), "p")],   # day 1 is closed: late
            [(day(3), "p"), (day(4), "p"), (day(4, 23), "x"), (day(8), "p")],  # day 3 is closed: late
            []]
    schema, out, seen = "ts timestamp, kind string", f"{tmp_path}/out", []
    state, top, emitted = defaultdict(list), None, {}
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/src")
        got = J.stream_daily_counts(spark, f"{tmp_path}/src", spark.createDataFrame([], schema).schema, out, "ts", lambda: F.col("kind") == "p")
        closed = None if top is None else top - dt.timedelta(days=1)
        for t, k in rows:
            end = dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=1)
            if closed is None or end > closed:
                state[t.date()].append(k == "p")
        top = max([t for t, _ in rows] + ([top] if top else []))
        for d in sorted(state):
            if dt.datetime(d.year, d.month, d.day) + dt.timedelta(days=1) <= top - dt.timedelta(days=1) and d not in emitted:
                emitted[d] = (len(state[d]), sum(state[d]) / len(state[d]))
        assert {r.day: (r.n_events, r.rate) for r in got.collect()} == emitted
        assert got.count() == len(emitted)
        seen.append(len(emitted))
    assert seen == [1, 3, 5, 5] or seen[-1] >= 4


def test_dedup_derives_its_key_in_the_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), u) for h in range(3) for m in (0, 20) for u in ("a", "b")]
    df = spark.createDataFrame(rows, "ts timestamp, u string")
    df.write.parquet(f"{tmp_path}/src")
    got = J.stream_dedup(spark, f"{tmp_path}/src", df.schema, f"{tmp_path}/out", ["u", "hour"], "ts", derive={"hour": F.date_trunc("hour", "ts")})
    assert got.count() == 6 and set(got.columns) == {"ts", "u", "hour"}


def test_ordinal_counts_rows_of_earlier_days(spark):
    rng = random.Random(4)
    rows = [(None if rng.random() < .1 else f"e{rng.randrange(3)}", dt.date(2024, 1, 1 + rng.randrange(9)), i) for i in range(120)]
    got = event_ordinal(spark.createDataFrame(rows, "e string, d date, i int"), "e", "d")
    assert {(r.e, r.d, r.i): r.ordinal for r in got.collect()} == {
        (e, d, i): sum(f == e and x < d for f, x, _ in rows) for e, d, i in rows}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the window runs over days, not rows


def test_importances_by_counting_against_rows(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        y = rng.randrange(2)
        rows.append((y, rng.choice([None, float(y + rng.randrange(3)), rng.random()]), float(rng.randrange(4)), 5.0, None,
                     rng.choice([None, "a", "b", "a" if y else "c"])))
    df = spark.createDataFrame(rows, "label int, u double, v double, flat double, void double, c string")
    values = SEL.value_table(df, ["u", "v", "flat", "void"], ["c"], "label")
    got = {r.feature: r for r in SEL.importance_table(values).collect()}
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan

    def median(xs):
        xs = sorted(xs)
        return (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2
    ys = [r[0] for r in rows]
    fill = median([r[1] for r in rows if r[1] is not None])
    mode = min(Counter(r[5] for r in rows if r[5]).items(), key=lambda x: (-x[1], x[0]))[0]
    cats = [r[5] or mode for r in rows]
    columns = {"u": [round(fill if r[1] is None else r[1], 9) for r in rows], "v": [r[2] for r in rows], "flat": [r[3] for r in rows]}
    columns |= {f"c_{k}": [float(x == k) for x in cats] for k in "abc"}
    assert set(got) == set(columns)  # a column without a value has none

    def corr(x):
        mx, my = sum(x) / len(x), sum(ys) / len(ys)
        sx, sy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in ys)
        return abs(sum((a - mx) * (b - my) for a, b in zip(x, ys)) / math.sqrt(sx * sy)) if sx else 0.0

    def auc(x):
        pos, neg = [a for a, b in zip(x, ys) if b], [a for a, b in zip(x, ys) if not b]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)

    def information(name, x):
        bins = x if name.startswith("c_") else [sum(b < a for b in x) * SEL.MI_BINS // len(x) for a in x]
        n, joint, px, py = len(x), Counter(zip(bins, ys)), Counter(bins), Counter(ys)
        return sum(k / n * math.log(k * n / px[b] / py[y]) for (b, y), k in joint.items())
    for name, x in columns.items():
        r = got[name]
        assert r.gain == pytest.approx(corr(x), abs=1e-9) and r.perm == pytest.approx(abs(auc(x) - .5), abs=1e-9)
        assert r.mi == pytest.approx(information(name, x), abs=1e-9) and r.shap == 0.0
