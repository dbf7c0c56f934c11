"""Registered streaming queries (M1-M4). Each run drains the source with an
``availableNow`` trigger into a fresh folder under the shared checkpoint dir
and returns the sink as a batch DataFrame, checked against its batch twin."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import score as SC
from ..operators.split import cutoff_value, quantile_cutoff
from ..operators.state import keep_state
from ..session import ensure_checkpoint_dir
from ..sources.tables import history, table
from ..streaming import jobs as J
from .feature_plans import rounded
from .registry import register
from .score_plans import SCORED_SQL, split_requests


def _run_dir(spark, name):
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _events_schema(spark, sf_dir):
    return table(spark, sf_dir, "events").schema


@register("stream_land", """
SELECT event_type, count(*) AS n, round(sum(value), 6) AS value_sum FROM events GROUP BY event_type
""")
def _stream_land(spark, sf_dir):
    out = J.stream_land(spark, sf_dir, _events_schema(spark, sf_dir), _run_dir(spark, "land"), "events.parquet")
    return rounded(out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


@register("stream_dedup", """
SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour, event_type FROM events
""")
def _stream_dedup(spark, sf_dir):
    d = J.stream_dedup(spark, sf_dir, _events_schema(spark, sf_dir), _run_dir(spark, "dedup"), ["user_id", "hour", "event_type"], "ts",
                       glob="events.parquet", derive={"hour": F.date_trunc("hour", "ts")})
    return d.select("user_id", "hour", "event_type")


# Events arrive in four parts by time; every tenth comes with the last part, most of those too late.
ARRIVALS = 4
_ARRIVED_SQL = f"""
r AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e AS (SELECT events.*, CASE WHEN event_id % 10 = 0 THEN {ARRIVALS - 1} ELSE
             CAST(least({ARRIVALS - 1}, (epoch_us(ts) - epoch_us(lo)) * {ARRIVALS} // (epoch_us(hi) - epoch_us(lo) + 1)) AS INTEGER) END AS part
      FROM events, r)"""


def arrivals(spark, sf_dir):
    """The events with the number of the part they arrive in."""
    events = table(spark, sf_dir, "events")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lo, hi = events.select(us("ts").alias("u")).agg(F.min("u"), F.max("u")).first()
    by_time = F.least(F.lit(ARRIVALS - 1), F.call_function("div", (us("ts") - F.lit(lo)) * ARRIVALS, F.lit(hi - lo + 1)))
    return events.withColumn("part", F.when(F.col("event_id") % 10 == 0, ARRIVALS - 1).otherwise(by_time).cast("int"))


@register("stream_daily_counts", f"""
WITH {_ARRIVED_SQL},
wm AS (SELECT p.part, (SELECT max(ts) - INTERVAL 1 DAY FROM e WHERE e.part < p.part) AS late_before FROM (SELECT DISTINCT part FROM e) p),
kept AS (SELECT e.* FROM e JOIN wm ON e.part = wm.part
         WHERE late_before IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > late_before)
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n_events,
       round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM kept WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1
""")
def _stream_daily(spark, sf_dir):
    """Each part lands, then the job runs until it has read everything and stops: four runs on one checkpoint."""
    source, out, parts = _run_dir(spark, "daily-src"), _run_dir(spark, "daily"), arrivals(spark, sf_dir)
    schema = _events_schema(spark, sf_dir)
    for k in range(ARRIVALS):
        parts.where(F.col("part") == k).drop("part").write.mode("append").parquet(source)
        got = J.stream_daily_counts(spark, source, schema, out, "ts", lambda: F.col("event_type") == "purchase")
    return rounded(got)


@register("stream_score", SCORED_SQL + """
SELECT contest_id, px, entity_id, round(p, 6) AS p,
       row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank FROM s
""")
def _stream_score(spark, sf_dir):
    """Three micro-batches of requests against a state that is aggregated once and kept."""
    allr = history(spark, sf_dir)
    lab = allr.where(F.col("finish_pos").isNotNull())
    c = cutoff_value(quantile_cutoff(lab, 0.2))
    kept = keep_state(lab, c, _run_dir(spark, "kept"))                   # Q12: state frozen at the cutoff
    targets_dir = _run_dir(spark, "score-src")
    # a contest is a request: it comes whole, in one file
    (allr.where(F.col("finish_pos").isNull() & (F.col("event_date") >= c)).repartition(3, "contest_id")
     .write.parquet(targets_dir))
    tschema = spark.read.parquet(targets_dir).schema

    def score_batch(batch):
        valid, _ = split_requests(batch)
        s = SC.rank_in_contest(SC.DEMO_SCORER(kept.score_rows(batch.sparkSession, valid, contest_cols=["contest_id"])),
                               ["contest_id"], "p", ["px"])
        return s.select("contest_id", "px", "entity_id", "p", F.col("rank").cast("long"))

    out = J.stream_score(spark, targets_dir, tschema, _run_dir(spark, "score"), score_batch, max_files=1)
    return rounded(out.drop("batch_id"))
