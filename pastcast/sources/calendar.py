"""Calendars and run logs.

Day records arrive as JSON text (possibly with a byte-order mark); malformed
dates are skipped, not fatal. Run logs are append-only long tables
``(run_id, parent_run_id, kind, key, value)``; comparisons pivot them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SCHEMA = "date STRING, has_program BOOLEAN, venue_id INT"


def parse_day_records(raw: DataFrame, text: str = "value") -> DataFrame:
    """JSON day records -> (venue_id, date DATE, has_program BOOLEAN);
    BOM stripped, malformed dates dropped, sorted by date."""
    clean = F.regexp_replace(F.col(text), "^\ufeff", "")
    rec = raw.select(F.from_json(clean, DAY_SCHEMA).alias("r")).select("r.*")
    return (rec.select("venue_id", F.try_to_date(F.col("date"), "yyyy-MM-dd").alias("date"),
                       F.coalesce(F.col("has_program"), F.lit(False)).alias("has_program"))
            .where(F.col("date").isNotNull()).orderBy("date", "venue_id"))


def calendar_window(days: DataFrame, today: Column, back: int, ahead: int) -> DataFrame:
    """Days in [today - back, today + ahead] that have a program."""
    return days.where(F.col("date").between(F.date_sub(today, back), F.date_add(today, ahead))
                      & F.col("has_program"))


def daily_target_grid(venues: DataFrame, today: Column, days: int = 2) -> DataFrame:
    """(today .. today+days-1) for every configured venue — a generator per
    venue row, no cross join."""
    return venues.select("venue_id", F.explode(F.sequence(today, F.date_add(today, days - 1))).alias("date"))


def run_log_rows(run_id: Column, parent: Column, kind: str, wide: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """A wide row of params / metrics -> long run-log rows via ``stack``."""
    pairs = ", ".join(f"'{k}', CAST(`{k}` AS DOUBLE)" for k in keys)
    return wide.select(run_id.alias("run_id"), parent.alias("parent_run_id"),
                       F.lit(kind).alias("kind"),
                       F.expr(f"stack({len(keys)}, {pairs})").alias("key", "value"))


def best_run(log: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """The run with the best value of ``metric`` (one aggregate)."""
    m = log.where((F.col("kind") == "metric") & (F.col("key") == metric))
    pick = F.max_by if maximize else F.min_by
    return m.agg(pick(F.struct("run_id", "value"), F.struct(F.col("value"), F.col("run_id"))).alias("b")) \
            .select(F.col("b.run_id").alias("run_id"), F.col("b.value").alias(metric))


def version_compare(log: DataFrame, base_run: str, cand_run: str, keys: Sequence[str]) -> DataFrame:
    """Metric table of two runs side by side with deltas (pivot)."""
    m = log.where((F.col("kind") == "metric") & F.col("key").isin(*keys)
                  & F.col("run_id").isin(base_run, cand_run))
    p = m.groupBy("key").pivot("run_id", [base_run, cand_run]).agg(F.first("value"))
    return p.select("key", F.col(base_run).alias("base"), F.col(cand_run).alias("candidate"),
                    (F.col(cand_run) - F.col(base_run)).alias("delta"))
