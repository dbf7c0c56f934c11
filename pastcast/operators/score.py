"""Batch scoring jobs.

Scoring takes an explicit ``history`` (the frozen state, Q12) and any number
of contests of ``targets`` in one job: features -> probability -> rank inside
each contest -> original entry order. No per-contest driver loop.

Two scorers share the interface ``scorer(df) -> df + p``:

* ``LinearScorer`` — a fixed logistic formula. Its probabilities, ranks and
  additive contributions are plain SQL, so every scoring query has an exact
  oracle; contributions are exact: ``coef * (x - mean)`` with
  ``base + sum(contrib) = logit(p)``.
* a fitted Spark ML ``PipelineModel`` via ``ml.model.model_scorer``.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class LinearScorer:
    intercept: float
    coef: dict[str, float]
    center: dict[str, float] = field(default_factory=dict)  # fill value = background mean
    name: str = "linear-fixed"
    version: str = "1"

    def filled(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(float(self.center.get(c, 0.0))))

    def logit(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, w in self.coef.items():
            z = z + F.lit(float(w)) * self.filled(c)
        return z

    def base_value(self) -> float:
        return self.intercept + sum(w * self.center.get(c, 0.0) for c, w in self.coef.items())

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit())))

    def contributions(self, df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
        """K8(a): long table (ids, feature, value, contribution) + base_value."""
        items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                          (F.lit(float(w)) * (self.filled(c) - F.lit(float(self.center.get(c, 0.0)))))
                          .alias("contribution")) for c, w in self.coef.items()]
        return df.select(*id_cols, F.explode(F.array(*items)).alias("_c")).select(
            *id_cols, "_c.*", F.lit(self.base_value()).alias("base_value"))


# --- fixed values: the reference-free demo scorer used by exact scoring checks
DEMO_SCORER = LinearScorer(
    intercept=-1.0,
    coef={"career_show_rate": 2.0, "jockey_career_show_rate": 1.0,
          "weight_kg_zscore_in_race": -0.25, "track_show_rate": 0.5},
    center={"career_show_rate": 0.4, "jockey_career_show_rate": 0.4,
            "weight_kg_zscore_in_race": 0.0, "track_show_rate": 0.4},
)
# --- end of fixed values -----------------------------------------------------


def rank_in_contest(df: DataFrame, contest: Sequence[str], p: str = "p",
                    entry_order: Sequence[str] = ("entry_pos",)) -> DataFrame:
    """1 = most likely; ties keep entry order. A contest is a request of at
    most 25 entries (C9) or a block of one sheet, so each window partition is small."""
    w = Window.partitionBy(*contest).orderBy(F.col(p).desc(), *[F.col(c) for c in entry_order])
    return df.withColumn("rank", F.row_number().over(w))


def contest_topn(ranked: DataFrame, n: int = 3) -> DataFrame:
    """The n most likely entries of every contest."""
    return ranked.where(F.col("rank") <= n)


def topk_contributions(contrib: DataFrame, id_cols: Sequence[str], k: int) -> DataFrame:
    """G1: per row the k features with the largest |contribution| (ties by
    name); value NULL when not finite. Partitions hold one row's features."""
    w = Window.partitionBy(*id_cols).orderBy(F.abs("contribution").desc(), F.col("feature"))
    v = F.col("value")
    return (contrib.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
            .withColumn("value", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)))


def argmax_row(df: DataFrame, p: str = "p", ties: Sequence[str] = ()) -> DataFrame:
    """The most confident prediction with its context (one aggregate); of
    equal ones the one with the least ``ties`` (numbers)."""
    order = F.struct(F.col(p), *[(-F.col(c)).alias(f"_t{i}") for i, c in enumerate(ties)])
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("_m")).select("_m.*")


def score_day_card(cells: DataFrame, readings: DataFrame, history: DataFrame, scorer, requested: DataFrame | None = None,
                   served_at: Column | None = None) -> DataFrame:
    """L3: every contest of every day card in one job. cells(file, row, cells)
    -> contests (B15/B16) -> entries (B17) -> distance by modal vote over the
    card's readings(file, seq, text) (B19) zipped by contest order (B18) ->
    default distance for features (C12, the source value is kept) ->
    point-in-time features against the frozen ``history`` -> probability ->
    rank within contest (F10) -> one nested record per contest (C11): file, status,
    contest_no, n_contests (of the card), start_time, distance_source_m, distance_used_m, n_entries, entries, the
    model's name and version, served_at (now by default). Empty contests have no entries and
    therefore no record. A ``requested`` file without a record has a row with status ``not_found`` instead."""
    from ..functions.scalars import norm_name
    from ..session import kept
    from . import grid as G
    from .features import point_in_time_features
    from .validate import default_fill, nest_results
    # the sheets are read once for the entries, the distances and the heads, and the targets once for all features
    contests = kept(G.card_contests(cells))
    entries = G.entry_rows(contests)
    votes = G.modal_vote(readings, ["file", "seq"], "seq", "text")
    dist = G.ordinal_zip(contests, votes.select("file", "seq", F.col("value").alias("distance_m")))
    heads = contests.where(F.col("row") == F.col("header_row")).select("file", "contest_no", "start_time")
    targets = kept(entries.join(dist, ["file", "contest_no"])
               .select("file", "contest_no", F.col("row").alias("entry_pos"),
                       norm_name("entity_name").alias("entity_id"),
                       G.doc_date(F.col("file")).alias("event_date"),
                       F.regexp_extract("file", r"_RT(\d+)_", 1).try_cast("int").alias("venue_id"),
                       F.col("distance_m").alias("distance_source_m"),
                       default_fill(F.col("distance_m")).cast("int").alias("distance_m"),
                       F.col("kg").alias("load_kg"), "post_position", "horse_age", "sex_code",
                       norm_name("rider_name").alias("rider_id")))
    # a card is not a request: no entry or group rule applies, ranks go by entry, never by name
    f = point_in_time_features(history, targets, contest_cols=["file", "contest_no"], reduce_history=True)
    ranked = rank_in_contest(scorer(f), ["file", "contest_no"], "p", ["entry_pos"])
    records = nest_results(ranked.withColumnRenamed("distance_m", "distance_used_m"),
                           ["file", "contest_no", "distance_source_m", "distance_used_m"],
                           ["entity_id", "p", "post_position", "rank", "horse_age", "sex_code", "load_kg", "rider_id"], order="rank")
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("n_contests"))
    out = (records.join(heads, ["file", "contest_no"]).join(counts, "file")
           .select("file", F.lit("ok").alias("status"), "contest_no", "n_contests", "start_time", "distance_source_m", "distance_used_m",
                   "n_entries", "entries"))
    if requested is not None:
        missing = requested.select("file").distinct().join(counts, "file", "left_anti")
        out = out.unionByName(missing.withColumn("status", F.lit("not_found")), allowMissingColumns=True)
    return out.withColumns({"model_name": F.lit(getattr(scorer, "name", "model")), "model_version": F.lit(getattr(scorer, "version", "")),
                            "served_at": served_at if served_at is not None else F.current_timestamp()})
