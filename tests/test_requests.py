"""Requests and day cards, frozen evaluation state, source changes, cell parsing, order-statistic plans."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pastcast.functions import scalars as S
from pastcast.operators import metrics, score, validate
from pastcast.operators.ranking import exact_quantiles
from pastcast.plans import ml_plans, source_plans
from pastcast.sources import tables

from test_grid_scalars import _one, _row


@pytest.mark.parametrize("text,seconds", [("34.37", 34.37), ("1'34", 94.0), ("1'34.37", 94.37), ("\t1'34''37 ", 94.37), ("34''37", 34.37),
                                          (" 34.5 ", 34.5), ("1'2'3", None), ("'", None), ("-", None), ("", None), ("1h34", None)])
def test_times(spark, text, seconds):
    assert _one(spark, S.time_to_seconds, text) == seconds


def test_names_lose_every_kind_of_space(spark):
    assert _one(spark, S.norm_name, " maria   luz\t") == "MARIA LUZ"
    assert _one(spark, S.norm_key, " 　") is None
    assert _one(spark, S.numeric_cell, " 55,5 ") == 55.5


def test_a_bad_entry_rejects_its_contest(spark):
    rows = [(1, "a", 50.0), (1, "b", 20.0), (2, "c", 50.0), (2, "C ", 51.0), (3, "d", 50.0), (3, "e", 51.0)]
    df = spark.createDataFrame(rows, "contest INT, name STRING, kg DOUBLE")
    valid, rejects = validate.split_valid(df, ["contest"], "name", validate.entry_violations(F.col("name"), F.col("kg")))
    assert {r.name for r in valid.collect()} == {"d", "e"} and valid.columns == df.columns
    assert {r.name: r.violations for r in rejects.collect()} == {
        "a": ["contest_rejected"], "b": ["kg_range"], "c": ["group_rule"], "C ": ["group_rule"]}


def test_rider_name_length(spark):
    df = spark.createDataFrame([("x" * 121,), ("x" * 120,), (None,)], "rider STRING")
    got = df.select(validate.entry_violations(F.lit("a"), F.lit(50.0), rider=F.col("rider")).alias("v")).collect()
    assert [r.v for r in got] == [["rider_length"], [], []]


def test_day_card_keeps_every_entry(spark):
    """A repeated name, 26 entries and an entry of age 1 are all in the card's record."""
    rows = {i: _row(26) for i in range(40)}
    rows[2] = _row(26, c7="PREMIO: Uno")
    for k in range(26):
        rows[3 + k] = _row(26, c0=str(k + 1), c2="Alpha" if k < 2 else f"Horse {chr(65 + k)}", c11="55", c14="m",
                           c15="1" if k == 5 else "4", c16="Ann")
    f = "Programa_RT1_20240601.xls"
    cells = spark.createDataFrame([(f, i, r) for i, r in rows.items()], "file STRING, row INT, cells ARRAY<STRING>")
    readings = spark.createDataFrame([(f, 1, "1600 mts")], "file STRING, seq INT, text STRING")
    hist = spark.createDataFrame([("ALPHA", dt.date(2024, 5, 1), 1, 1, 55.0, 1600, "ANN")],
                                 "entity_id STRING, event_date DATE, venue_id INT, finish_pos INT, load_kg DOUBLE, distance_m INT, rider_id STRING")
    out = score.score_day_card(cells, readings, hist, score.DEMO_SCORER).collect()
    assert [r.n_entries for r in out] == [26]
    assert sorted(e.rank for e in out[0].entries) == list(range(1, 27))
    assert [e.entity_id for e in out[0].entries].count("ALPHA") == 2


def test_argmax_ties(spark):
    df = spark.createDataFrame([(2, 1, 0.9), (1, 5, 0.9), (1, 4, 0.9), (0, 0, 0.1)], "contest INT, px INT, p DOUBLE")
    assert tuple(score.argmax_row(df, "p", ["contest", "px"]).first()) == (1, 4, 0.9)


def test_history_follows_its_source(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for name in ("lineitem", "orders", "customer", "nation"):
        spark.read.parquet(f"{src}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert tables.history(spark, str(tmp_path)).count() == 6000
    spark.read.parquet(f"{src}/lineitem.parquet").limit(1000).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert tables.history(spark, str(tmp_path)).count() == 1000
    one, two = (source_plans._scratch(spark, "x", f"{tmp_path}/{d}/same") for d in "ab")
    assert one != two


def test_evaluation_state_is_frozen(spark):
    """Outcomes of the test period change no test feature."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(e, c, float(e), day(c), 1, 1000, 50.0 + e, (e + c) % 7 + 1, e % 3, None) for c in range(20) for e in range(5)]
    schema = ("entity_id BIGINT, contest_id BIGINT, px DOUBLE, event_date DATE, venue_id INT, distance_m INT, load_kg DOUBLE, "
              "finish_pos INT, rider_id BIGINT, dividend DOUBLE")
    base = spark.createDataFrame(rows, schema).withColumn("label", F.col("finish_pos").between(1, 3).cast("int"))
    cut = day(15)
    changed = base.withColumn("finish_pos", F.when(F.col("event_date") >= cut, 8 - F.col("finish_pos")).otherwise(F.col("finish_pos")))
    a, b = (ml_plans._frozen(spark, x)[1] for x in (base, changed))
    names = [c for c in a.columns if c not in ("finish_pos", "label")]
    assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))
    assert a.agg(F.max("career_runs"), F.min("career_runs")).first() == (15, 15)  # the days before the cutoff, day 15


def test_order_statistics_join_nothing_crosswise(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 7 % 101).alias("s"))
    for out in (metrics.roc_auc(df, "y", "s"), metrics.calibration_bins(df, "y", "s"), exact_quantiles(df, "s", [0.1, 0.5]),
                metrics.binary_metrics(df, "y", "s", by=["g"]), metrics.binary_metrics(df, "y", "s")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoopJoin", plan)
    values = sorted(r.s for r in df.collect())
    got = {r.q: r.value for r in exact_quantiles(df, "s", [0.0, 0.25, 0.5, 1.0]).collect()}
    for q, v in got.items():
        h = q * (len(values) - 1)
        lo = int(h)
        assert v == pytest.approx(values[lo] + (h - lo) * (values[min(lo + 1, len(values) - 1)] - values[lo]))
    assert exact_quantiles(df.limit(0), "s", [0.5]).count() == 0


def test_replayed_batch_replaces_itself(spark, tmp_path):
    from pastcast.streaming import jobs
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(src)
    schema = spark.read.parquet(src).schema
    once = jobs.stream_score(spark, src, schema, out, lambda b: b).drop("batch_id").collect()
    # the checkpoint of the first run is lost: the same files arrive as batch 0 again
    import os
    os.rename(f"{out}/_checkpoint", f"{out}/_lost")
    again = jobs.stream_score(spark, src, schema, out, lambda b: b).drop("batch_id").collect()
    assert len(once) == 10 and sorted(map(str, once)) == sorted(map(str, again))


def test_anchors_resolve_to_images_of_enough_size(spark):
    from pastcast.operators import grid
    anchors = spark.createDataFrame([("f", 9, "r1"), ("f", 3, "r2"), ("f", 5, "r3"), ("f", 7, "none")], "file STRING, anchor_row INT, rel_id STRING")
    rels = spark.createDataFrame([("f", "r1", "a.png"), ("f", "r2", "b.png"), ("f", "r3", "logo.png")], "file STRING, rel_id STRING, target STRING")
    media = spark.createDataFrame([("f", "a.png", 900, 500), ("f", "b.png", 800, 400), ("f", "logo.png", 799, 900)],
                                  "file STRING, target STRING, width INT, height INT")
    assert [(r.target, r.seq) for r in grid.anchor_resolve(anchors, rels, media).orderBy("seq").collect()] == [("b.png", 1), ("a.png", 2)]
