"""The as-of state kept as tables, for scoring jobs that run again and again (L1-L3, M3).

``point_in_time_features`` aggregates the history in every call. A service scores small requests against a history
that changes once a day: here the history is aggregated once, into one row per entity (career, years,
last runs, venues, distances) and one per rider, frozen before a day. The tables are bucketed by key, so a request
is joined with them by shuffling the request alone. Targets on or after that day get exactly the features of
``point_in_time_features``; a target before it needs an older state and is refused.

An entity's maps are bounded: years and venues are dimensions, distances are whole metres of a course.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import DAY, day_number
from .features import _rate, contract, day_states, history_rows, state_features, target_rows, with_contest

#: Buckets of the tables; a cluster sets it to its shuffle partitions.
BUCKETS = 16


@dataclass(frozen=True)
class KeptState:
    """Names of the two tables, and the day before which the history was frozen (unix day number)."""

    entities: str
    riders: str
    before_day: int
    last_n: int
    band_m: int

    def score_rows(self, spark: SparkSession, targets: DataFrame, contest_cols=None) -> DataFrame:
        """The feature contract of ``targets`` (on or after the frozen day) by two joins with the kept tables."""
        k = self.last_n
        Tgt = target_rows(targets)
        # a target of an older day must not see this state
        ok = F.col(DAY).isNull() | (F.col(DAY) >= self.before_day)
        Tgt = Tgt.withColumn(DAY, F.when(ok, F.col(DAY)).otherwise(
            F.raise_error(F.lit("the kept state is younger than a target")).cast("int")))
        probes = Tgt.where(F.col("_e").isNotNull() & F.col(DAY).isNotNull()).select("_e", DAY, "_yr", "_v", "_td").distinct()
        kept = spark.table(self.entities)
        year, venue, band = F.col("years")[F.col("_yr")], F.col("venues")[F.col("_v")], F.filter(
            "distances", lambda x: F.abs(x["dist"] - F.col("_td")) <= self.band_m)
        total = lambda field: F.aggregate(band, F.lit(0).cast("long"), lambda s, x: s + x[field])
        P = probes.join(kept, "_e", "left").withColumns({
            **{f"y_{c}": year[c] for c in ("n", "w1", "w2", "w3")}, "g_cn": venue["n"], "g_cs": venue["s"],
            "b_n": total("n"), "b_s": total("s")})
        feats = P.select(*state_features(k, None, True, True))
        out = Tgt.join(feats, (Tgt["_e"] == feats["f_e"]) & (Tgt[DAY] == feats["f_day"])
                       & Tgt["_v"].eqNullSafe(feats["f_v"]) & Tgt["_td"].eqNullSafe(feats["f_td"]), "left")
        rf = spark.table(self.riders).select(F.col("_r").alias("fr_r"), F.col("cr_n").alias("jockey_career_runs"),
                                             _rate(F.col("cr_s"), F.col("cr_n")).alias("jockey_career_show_rate"))
        out = out.join(rf, (out["_r"] == rf["fr_r"]) & out[DAY].isNotNull(), "left")
        return contract(with_contest(out, Tgt, contest_cols), targets, Tgt, feats, rf, k)


def entity_states(H: DataFrame, k: int, salt_buckets: int = 64) -> DataFrame:
    """One row per entity of ``history_rows``: what a probe on a later day needs."""
    days = day_states(H, k, salt_buckets)
    # An entity's last runs lie in its last k days with runs; so many arrays are merged, no more.
    late = Window.partitionBy("_e").orderBy(F.col(DAY).desc())
    paid = F.count("e_dtop").over(late.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = days.withColumns({"_rank": F.row_number().over(late), "_paid": paid})
    career = ranked.groupBy("_e").agg(
        *[F.sum(f"e_{c}").alias(f"c_{c}") for c in ("n", "w1", "w2", "w3", "dsum", "dn", "vsum", "vn")],
        F.min("e_vmin").alias("c_vmin"), F.max("e_win").alias("c_win"), F.max_by("e_first", DAY).alias("l_first"),
        *[F.max(F.when(F.col("_rank") == i, F.col("e_top"))).alias(f"l_top{i}") for i in range(1, k + 1)],
        *[F.max(F.when((F.col("_paid") == i) & F.col("e_dtop").isNotNull(), F.col("e_dtop"))).alias(f"l_dtop{i}") for i in range(1, 4)])
    p = F.col("_pos")
    years = days.groupBy("_e", "_yr").agg(*[F.sum(f"e_{c}").alias(c) for c in ("n", "w1", "w2", "w3")])
    places = H.groupBy("_e", "_v", "_dist").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.between(1, 3)).alias("s"))
    venues = places.where("_v IS NOT NULL").groupBy("_e", "_v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    distances = places.where("_dist IS NOT NULL").groupBy("_e", F.col("_dist").alias("dist")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    as_map = lambda key, *cols: F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*cols))))
    return (career.join(years.groupBy("_e").agg(as_map("_yr", "n", "w1", "w2", "w3").alias("years")), "_e", "left")
            .join(venues.groupBy("_e").agg(as_map("_v", "n", "s").alias("venues")), "_e", "left")
            .join(distances.groupBy("_e").agg(F.collect_list(F.struct("dist", "n", "s")).alias("distances")), "_e", "left"))


def rider_states(H: DataFrame) -> DataFrame:
    """One row per rider of ``history_rows``."""
    return H.where("_r IS NOT NULL").groupBy("_r").agg(F.count(F.lit(1)).alias("cr_n"), F.count_if(F.col("_pos").between(1, 3)).alias("cr_s"))


def keep_state(history: DataFrame, before, folder: str, last_n: int = 3, band_m: int = 100, buckets: int = BUCKETS,
               salt_buckets: int = 64) -> KeptState:
    """Freeze ``history`` before the day ``before`` (a date) into two tables under ``folder`` (shared storage)."""
    spark = history.sparkSession
    day = spark.range(1).select(day_number(F.lit(before)).alias("d")).first().d
    H = history_rows(history).where(F.col(DAY) < day)
    tag = uuid.uuid4().hex[:12]
    names = [f"kept_entities_{tag}", f"kept_riders_{tag}"]
    for name, key, df in zip(names, ("_e", "_r"), (entity_states(H, last_n, salt_buckets), rider_states(H))):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(name)
    return KeptState(*names, day, last_n, band_m)
