"""Point-in-time (leak-free) features: E1-E7, F1-F9, D1-D7, C3-C7.

``point_in_time_features(history, targets)`` returns every target row (1:1,
duplicates kept) with the 35-column feature contract appended. For a target
(entity e, day d) every historical feature aggregates *only* history rows of
e with day < d — strictly earlier days, so nothing of the target's own day
leaks in. ``history`` and ``targets`` are separate relations: training passes
the same frame twice, evaluation fits on train and featurises test.

Physical plan (see ``asof.py`` for the why):

* history -> one row per (entity, day) of partial states, with a salted
  top-k for the "last N runs" state; one row per (entity, day, venue,
  distance) of counts; one row per (rider, day) of counts. All are
  map-side-combined aggregations.
* one union of those day rows with the distinct target probes, hash
  partitioned once by entity; cumulative windows over (year, day, side)
  give career / year / last-run state, a second sort over
  (venue | distance key) gives the track and distance-band state. Band
  probes come from a bucketed equi-join (entity, 100 m bucket).
* contest statistics (z-score, field size) are a grouped aggregate joined
  back on the contest key, so a huge contest is never one window partition.
* the per-probe results are attached to targets with equi-joins.

With a lookback of L days an entity of at most ``FRAME_ROWS`` history rows, which has few in any frame, is done
without windows: days are cut into blocks of L, the frame of a day lies in its block and the one before,
and an equi-join on (entity, block) meets each day with the rows it sees. A longer history has two
probes, at the day and L days earlier. Sums over the
frame are the difference of two running sums. The least dividend, which has no difference, is the
least of two running minima: the frame is the end of one block and the beginning of the next.

``reduce_history`` keeps only the history of the targets' entities and riders, for scoring
jobs whose targets are few beside the history.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import norm_key
from ..schema import ALL_FEATURES, feature_type, last_n_names
from .asof import (DAY, SIDE, co_partition, cumulative, day_number, dealt_by, hot_keys, lag_ignore_nulls, merge_top_k, only_keys,
                   require_columns, salted_top_k, union_all, unique_columns)

ALL_GROUPS = frozenset({"entity", "venue", "band", "rider", "contest"})

REQUIRED_HISTORY = ["entity_id", "event_date", "venue_id", "finish_pos", "load_kg", "distance_m"]
REQUIRED_TARGETS = ["entity_id", "event_date", "distance_m", "venue_id", "load_kg"]


def _key(df: DataFrame, name: str) -> Column:
    """Entity / rider key: strings are normalised (C7), other types kept."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    dt = df.schema[name].dataType
    return norm_key(name) if isinstance(dt, T.StringType) else F.col(name)


def _opt(df: DataFrame, name: str | None, dtype: str) -> Column:
    if name and name in df.columns:
        return F.col(name).cast(dtype)
    return F.lit(None).cast(dtype)


def _tiebreak(df: DataFrame, tiebreak: Sequence[str]) -> list[Column]:
    if all(c in df.columns for c in tiebreak):
        return [F.col(c) for c in tiebreak]
    # no explicit tie-break: a content hash still gives one deterministic order
    return [F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(0)]


def _count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def history_rows(history: DataFrame, *, entity: str = "entity_id", date: str = "event_date", venue: str = "venue_id",
                 distance: str = "distance_m", kg: str = "load_kg", pos: str = "finish_pos", dividend: str = "dividend",
                 rider: str = "rider_id", tiebreak: Sequence[str] = ("contest_id", "px")) -> DataFrame:
    """The columns of history that states are made of; rows without a position, entity or day go."""
    tb = _tiebreak(history, tiebreak)
    return (history.where(F.col(pos).isNotNull())
         .select(_key(history, entity).alias("_e"),
                 day_number(date).alias(DAY),
                 F.year(F.col(date)).alias("_yr"),
                 F.col(venue).cast("int").alias("_v"),
                 F.col(distance).cast("int").alias("_dist"),
                 F.nanvl(F.col(kg).cast("double"), F.lit(None).cast("double")).alias("_kg"),
                 F.col(pos).cast("int").alias("_pos"),
                 F.nanvl(_opt(history, dividend, "double"), F.lit(None).cast("double")).alias("_div"),
                 _key(history, rider).alias("_r"),
                 tb[0].alias("_tb0"), tb[1].alias("_tb1"))
         .where(F.col("_e").isNotNull() & F.col(DAY).isNotNull()))


def target_rows(targets: DataFrame, *, entity: str = "entity_id", date: str = "event_date", venue: str = "venue_id",
                distance: str = "distance_m", kg: str = "load_kg", rider: str = "rider_id") -> DataFrame:
    """The targets with their keys: entity, day, year, venue, distance, load, rider."""
    return targets.select(
        "*",
        _key(targets, entity).alias("_e"),
        day_number(date).alias(DAY),
        F.year(F.col(date)).alias("_yr"),
        F.col(venue).cast("int").alias("_v"),
        F.col(distance).cast("int").alias("_td"),
        F.nanvl(F.col(kg).cast("double"), F.lit(None).cast("double")).alias("_tk"),
        _key(targets, rider).alias("_r"),
    )


def day_states(H: DataFrame, k: int, salt_buckets: int) -> DataFrame:
    """One row of partial states per (entity, day) of ``history_rows``."""
    p = F.col("_pos")
    day_aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(p == 1).alias("w1"),
        F.count_if(p == 2).alias("w2"),
        F.count_if(p == 3).alias("w3"),
        F.sum("_dist").alias("dsum"),
        F.count("_dist").alias("dn"),
        F.sum("_div").alias("vsum"),
        F.count("_div").alias("vn"),
        F.min("_div").alias("vmin"),
        F.min(F.struct("_tb0", "_tb1", "_pos", "_kg")).alias("first"),
    ]
    topk = {
        "top": (F.lit(True), F.struct(DAY, "_tb0", "_tb1", "_pos")),
        "dtop": (F.col("_div").isNotNull(), F.struct(DAY, "_tb0", "_tb1", "_div")),
    }
    partial = salted_top_k(H, ["_e", DAY, "_yr"], ["_tb0", "_tb1"], max(k, 3),
                           salt_buckets, day_aggs, topk)
    return (partial.groupBy("_e", DAY, "_yr").agg(
        F.sum("n").alias("e_n"), F.sum("w1").alias("e_w1"), F.sum("w2").alias("e_w2"),
        F.sum("w3").alias("e_w3"), F.sum("dsum").alias("e_dsum"), F.sum("dn").alias("e_dn"),
        F.sum("vsum").alias("e_vsum"), F.sum("vn").alias("e_vn"), F.min("vmin").alias("e_vmin"),
        F.min("first").alias("_first"),
        merge_top_k("top", k).alias("e_top"),
        merge_top_k("dtop", 3).alias("_dtop"))
        .select("_e", DAY, "_yr", "e_n", "e_w1", "e_w2", "e_w3", "e_dsum", "e_dn",
                "e_vsum", "e_vn", "e_vmin", "e_top",
                F.when(F.col("e_w1") > 0, F.col(DAY)).alias("e_win"),
                F.struct(F.col(DAY).alias("day"), F.col("_first._pos").alias("pos"),
                         F.col("_first._kg").alias("kg")).alias("e_first"),
                F.when(F.size("_dtop") > 0, F.col("_dtop")).alias("e_dtop"))
        .withColumn(SIDE, F.lit(1)))


#: History rows of an entity up to which a lookback meets each of them with the days that see it; a day sees so many at most.
FRAME_ROWS = 300


def frame_states(H: DataFrame, probes: DataFrame, k: int, L: int, venue: bool, band: bool, band_m: int) -> DataFrame:
    """The states (see ``state_features``) of the probes that see any of ``history_rows`` within ``L`` days. A row is met by each
    distinct day that sees it, L at most, whatever the number of probes of the day; rows of a day are kept, so entities must be short."""
    p, d, pd = F.col("_pos"), F.col(DAY), F.col("_pd")
    block = lambda day: F.floor(day / L)
    runs = H.drop("_r").repartition("_e").withColumn("_blk", block(d))
    days = probes.select("_e", d.alias("_pd")).distinct().withColumn("_blk", F.explode(F.array(block(pd), block(pd) - 1)))
    year = F.col("_yr") == F.year(F.date_from_unix_date(pd))
    run = F.struct(DAY, "_tb0", "_tb1", "_pos", "_div", "_v", "_dist")
    seen = days.join(runs, ["_e", "_blk"]).where((d < pd) & (d >= pd - L)).groupBy("_e", "_pd").agg(
        F.count(F.lit(1)).alias("c_n"), *[F.count_if(p == i).alias(f"c_w{i}") for i in (1, 2, 3)],
        F.sum("_dist").alias("c_dsum"), F.count("_dist").alias("c_dn"), F.sum("_div").alias("c_vsum"), F.count("_div").alias("c_vn"),
        F.min("_div").alias("c_vmin"), F.max(F.when(p == 1, d)).alias("c_win"),
        F.count_if(year).alias("y_n"), *[F.count_if(year & (p == i)).alias(f"y_w{i}") for i in (1, 2, 3)],
        F.min(F.struct((-d).alias("ago"), "_tb0", "_tb1", "_pos", "_kg")).alias("_first"), F.sort_array(F.collect_list(run), asc=False).alias("_runs"))
    first = F.struct((-F.col("_first.ago")).alias("day"), F.col("_first._pos").alias("pos"), F.col("_first._kg").alias("kg"))
    m, tie = max(k, 3), (DAY, "_tb0", "_tb1")

    def few(runs):
        """Of runs that tie, those of the ``m`` least positions, as ``day_states`` keeps the first ones of a contest."""
        tied = lambda x, y: reduce(and_, [y[c].eqNullSafe(x[c]) for c in tie])
        return F.when(F.size(runs) <= m, F.col(runs)).otherwise(F.filter(runs, lambda x, i: ~tied(x, F.get(runs, i + m))))
    P = probes.join(seen.withColumnRenamed("_pd", DAY), ["_e", DAY]).withColumns({
        "l_first": first, "l_top1": F.slice(few("_runs"), 1, k), "_paid": F.filter("_runs", lambda x: x["_div"].isNotNull())})
    P = P.withColumn("l_dtop1", F.slice(F.sort_array(F.transform(few("_paid"), lambda x: F.struct(*[x[c].alias(c) for c in (*tie, "_div")])), asc=False), 1, 3))

    def count(among, show):
        flags = F.filter("_runs", lambda x: among(x) & x["_pos"].between(1, 3) if show else among(x))
        return F.size(flags).cast("long")
    for on, near, names in ((venue, lambda x: x["_v"] == F.col("_v"), ("g_cn", "g_cs")),
                            (band, lambda x: F.abs(x["_dist"] - F.col("_td")) <= band_m, ("b_n", "b_s"))):
        if on:
            P = P.withColumns({name: count(near, show) for name, show in zip(names, (False, True))})
    none = lambda c: F.when(F.lit(False), F.col(c))
    return P.withColumns({f"l_top{i}": none("l_top1") for i in range(2, k + 1)} | {f"l_dtop{i}": none("l_dtop1") for i in (2, 3)})


def state_features(k: int, L: int | None, venue: bool, band: bool) -> list[Column]:
    """The features of a probe (_e, DAY, _v, _td) from its state: c_* career, y_* year, l_* last runs, g_* venue, b_* band."""
    d = F.col(DAY)
    fresh = (lambda s: s.isNotNull()) if L is None else (lambda s: s.isNotNull() & (s >= d - L))
    last = F.col("l_first")
    last_ok = fresh(last["day"])
    top = F.flatten(F.array_compact(F.array(*[F.col(f"l_top{i}") for i in range(1, k + 1)])))
    dtop = F.flatten(F.array_compact(F.array(*[F.col(f"l_dtop{i}") for i in range(1, 4)])))
    if L is not None:
        top = F.filter(top, lambda x: x[DAY] >= d - L)
        dtop = F.filter(dtop, lambda x: x[DAY] >= d - L)
    top = F.slice(top, 1, k)
    dtop = F.slice(dtop, 1, 3)
    tpos = F.transform(top, lambda x: x["_pos"].cast("double"))
    tdiv = F.transform(dtop, lambda x: x["_div"])

    def arr_mean(a: Column) -> Column:
        return F.when(F.size(a) > 0,
                      F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a))

    z, rate = _count, _rate
    avg_name, best_name = last_n_names(k)
    fcols = [
        F.col("_e").alias("f_e"), F.col(DAY).alias("f_day"), F.col("_v").alias("f_v"),
        F.col("_td").alias("f_td"),
        z("c_n").alias("career_runs"), z("c_w1").alias("career_wins"),
        z("c_w2").alias("career_places"), z("c_w3").alias("career_shows"),
        rate(z("c_w1"), z("c_n")).alias("career_win_rate"),
        rate(z("c_w1") + z("c_w2") + z("c_w3"), z("c_n")).alias("career_show_rate"),
        z("y_n").alias("year_runs"), z("y_w1").alias("year_wins"),
        z("y_w2").alias("year_places"), z("y_w3").alias("year_shows"),
        rate(z("y_w1"), z("y_n")).alias("year_win_rate"),
        rate(z("y_w1") + z("y_w2") + z("y_w3"), z("y_n")).alias("year_show_rate"),
        F.when(last_ok, last["pos"].cast("double")).alias("last_finish_pos"),
        arr_mean(tpos).alias(avg_name),
        F.array_min(tpos).alias(best_name),
        F.when(last_ok, (d - last["day"]).cast("double")).alias("rest_days"),
        (d - F.col("c_win")).cast("double").alias("days_since_last_win"),
        rate(F.col("c_vsum"), F.col("c_vn")).alias("dividend_career_mean"),
        arr_mean(tdiv).alias("dividend_last3_mean"),
        F.col("c_vmin").cast("double").alias("dividend_career_min"),
        (F.col("_td") - rate(F.col("c_dsum"), F.col("c_dn"))).alias("dist_diff_from_avg"),
        F.when(last_ok, last["kg"]).alias("_last_kg"),
    ]
    if venue:
        has_v = F.col("_v").isNotNull()
        fcols += [F.when(has_v, z("g_cn")).otherwise(F.lit(0).cast("long")).alias("track_runs"),
                  F.when(has_v, rate(F.col("g_cs"), F.col("g_cn"))).alias("track_show_rate")]
    if band:
        has_d = F.col("_td").isNotNull()
        fcols += [F.when(has_d, z("b_n")).otherwise(F.lit(0).cast("long")).alias("dist_bucket_runs"),
                  F.when(has_d, rate(F.col("b_s"), F.col("b_n"))).alias("dist_bucket_show_rate")]
    return fcols


def with_contest(out: DataFrame, Tgt: DataFrame, contest_cols: Sequence[str] | None) -> DataFrame:
    """Targets with the mean, spread and size of their contests (_kmean, _kstd, n_field)."""
    # Q6/Q7: contest = (date, venue, distance); NULL keys form their own group;
    # n_field counts non-null kg. A grouped aggregate + equi-join, not a window.
    ckeys = [DAY, "_v", "_td"] if contest_cols is None else list(contest_cols)
    cs = (Tgt.groupBy(*[F.col(c).alias(f"_fc{i}") for i, c in enumerate(ckeys)])
          .agg(F.avg("_tk").alias("_kmean"), F.stddev_samp("_tk").alias("_kstd"),
               F.count("_tk").alias("n_field")))
    cond = None
    for i, c in enumerate(ckeys):
        e = out[c].eqNullSafe(cs[f"_fc{i}"])
        cond = e if cond is None else cond & e
    return out.join(cs, cond, "left")


def contract(out: DataFrame, targets: DataFrame, Tgt: DataFrame, feats: DataFrame, rf: DataFrame | None, k: int,
             contest: bool = True) -> DataFrame:
    """The output contract: the columns of ``targets`` and every feature, of targets joined with their contests and features."""
    avg_name, best_name = last_n_names(k)

    # ------------------------------------------------ the output contract
    produced = {
        "weight_kg": F.col("_tk"),
        "racetrack_id": F.col("_v"),
        "weight_change_from_last": F.col("_tk") - F.col("_last_kg"),
    }
    if contest:
        produced["weight_kg_zscore_in_race"] = F.try_divide(
            F.col("_tk") - F.col("_kmean"), F.nullif(F.col("_kstd"), F.lit(0.0)))
        produced["n_field"] = F.col("n_field")
    for opt_col in ("horse_age", "post_position", "sex_code"):
        if opt_col not in targets.columns:
            produced[opt_col] = F.lit(None)
    sources = {c: feats[c] for c in feats.columns}
    if rf is not None:
        sources.update({c: rf[c] for c in ("jockey_career_runs", "jockey_career_show_rate")})
    feature_cols = []
    names = [n for n in ALL_FEATURES
             if not (k != 3 and n in ("avg_finish_last3", "best_finish_last3"))]
    if k != 3:
        names += [avg_name, best_name]
    for name in names:
        src = produced.get(name)
        if src is None and name in sources:
            src = sources[name]
        if src is None and name in targets.columns:
            src = Tgt[name]
        if src is None:
            # group not requested: keep the contract (C3); absent counts are 0
            src = F.lit(0) if feature_type(name) == T.LongType() else F.lit(None)
        dtype = feature_type(name) if name in ALL_FEATURES else T.DoubleType()
        if dtype == T.LongType() and name != "n_field":
            # no matching probe (no rider, NULL key): a rookie's count is 0
            src = F.coalesce(src, F.lit(0))
        feature_cols.append(src.cast(dtype).alias(name))
    keep = [Tgt[c] for c in targets.columns if c not in set(names)]
    return unique_columns(out.select(*keep, *feature_cols))


def _running_states(H: DataFrame, probes: DataFrame, k: int, L: int | None, groups: frozenset, salt_buckets: int, band_m: int) -> DataFrame:
    """The states (see ``state_features``) of the probes by windows over the day rows of ``history_rows``."""
    # ---------------------------------------------- (entity, day) history state
    p = F.col("_pos")
    hot = hot_keys(H, "_e")
    ehist = dealt_by(H, "_e", hot, lambda rows: day_states(rows, k, salt_buckets))

    # rows by kind: 0 probes, 1 day states, 2 venue | distance counts, 3 band probes,
    # 4 and 5 the second probes of a lookback (of 0 and 3)
    frames = {0: probes.withColumn(SIDE, F.lit(0)).withColumn("_kind", F.lit(0))
              .withColumn("_gkk", F.lit(1)).withColumn("_gk", F.col("_v")),
              1: ehist.withColumn("_kind", F.lit(1))}
    # with a lookback, a second probe at the first day of the frame; ``_pd`` is the day a probe is for
    back = lambda f, kind: (f.withColumn("_pd", F.col(DAY)).withColumn(DAY, F.col(DAY) - L)
                            .withColumn("_yr", F.year(F.date_from_unix_date(DAY))).withColumn("_kind", F.lit(kind)))

    # ------------------------ (entity, venue | distance, day) history counts
    if "venue" in groups or "band" in groups:
        places = dealt_by(H.select("_e", DAY, "_yr", "_v", "_dist", p.between(1, 3).alias("_show")), "_e", hot, lambda rows: rows.groupBy(
            "_e", DAY, "_yr", "_v", "_dist").agg(F.count(F.lit(1)).alias("g_n"), F.count_if("_show").alias("g_s")))
        gk = []
        if "venue" in groups:
            gk.append(F.struct(F.lit(1).alias("kk"), F.col("_v").alias("k")))
        if "band" in groups:
            gk.append(F.struct(F.lit(2).alias("kk"), F.col("_dist").alias("k")))
        vb = (places.select("_e", DAY, "_yr", "g_n", "g_s", F.explode(F.array(*gk)).alias("_g"))
              .select("_e", DAY, "_yr", "g_n", "g_s", F.col("_g.kk").alias("_gkk"),
                      F.col("_g.k").alias("_gk"))
              .withColumn(SIDE, F.lit(1)).withColumn("_kind", F.lit(2)))
        frames[2] = vb
    if "band" in groups:
        # probe expansion: the entity's distinct history distances within the
        # band, found with an equi-join on (entity, band bucket) + exact filter
        hd = (H.where(F.col("_dist").isNotNull()).select("_e", "_dist").distinct().repartition("_e")
              .withColumn("_bk", F.floor(F.col("_dist") / band_m)))
        tb_ = F.floor(F.col("_td") / band_m)
        bprobe = (probes.where(F.col("_td").isNotNull()).select("_e", DAY, "_yr", "_td").distinct()
                  .withColumn("_bk", F.explode(F.array(tb_ - 1, tb_, tb_ + 1)))
                  .join(hd, ["_e", "_bk"])
                  .where(F.abs(F.col("_dist") - F.col("_td")) <= band_m)
                  .select("_e", DAY, "_yr", "_td", F.lit(2).alias("_gkk"),
                          F.col("_dist").alias("_gk"))
                  .withColumn(SIDE, F.lit(0)).withColumn("_kind", F.lit(3)))
        frames[3] = bprobe
    if L is not None:
        frames[4] = back(frames[0], 4)
        if 3 in frames:
            frames[5] = back(frames[3], 5)

    # Two unions keyed by the same probe: entity state (probes + entity-day
    # rows) and venue / band state (probes + venue|distance-day rows + band
    # probes). The entity windows then only see entity rows, so their sort and
    # the lag ... IGNORE NULLS scans stay small; both sides come out hash
    # partitioned by entity and meet again on the probe key.
    frames = {kind: f if "_pd" in f.columns else f.withColumn("_pd", F.col(DAY)) for kind, f in frames.items()}
    UE = union_all([frames[kind] for kind in (0, 1, 4) if kind in frames])
    order = ["_yr", DAY, SIDE]
    wE = cumulative(["_e"], order)
    wY = cumulative(["_e", "_yr"], [DAY, SIDE])
    lag = lambda c, i: lag_ignore_nulls(c, i, ["_e"], order)

    sums = {"c_n": "e_n", "c_w1": "e_w1", "c_w2": "e_w2", "c_w3": "e_w3", "c_dsum": "e_dsum", "c_dn": "e_dn",
            "c_vsum": "e_vsum", "c_vn": "e_vn"}
    years = {"y_n": "e_n", "y_w1": "e_w1", "y_w2": "e_w2", "y_w3": "e_w3"}
    cols = [
        *[F.sum(c).over(wE).alias(n) for n, c in sums.items()],
        F.min("e_vmin").over(wE).alias("c_vmin"), F.max("e_win").over(wE).alias("c_win"),
        *[F.sum(c).over(wY).alias(n) for n, c in years.items()],
        lag("e_first", 1).alias("l_first"),
        *[lag("e_top", i).alias(f"l_top{i}") for i in range(1, k + 1)],
        *[lag("e_dtop", i).alias(f"l_dtop{i}") for i in range(1, 4)],
    ]
    if L is not None:
        # the block that a probe's last or first day of the frame, or a day of history, is in
        day = F.when(F.col("_kind") == 0, F.col(DAY) - 1).otherwise(F.col(DAY))
        UE = UE.withColumn("_blk", day - F.pmod(day, F.lit(L)))
        cols[len(sums)] = F.when(F.col("_kind") == 0, F.min("e_vmin").over(cumulative(["_e", "_blk"], [DAY, SIDE]))).otherwise(
            F.min("e_vmin").over(cumulative(["_e", "_blk"], [F.col(DAY).desc(), F.col(SIDE).desc()]))).alias("c_vmin")
    ids = ["_kind", "_e", "_pd", "_yr", "_v", "_td"]
    W = UE.select(*ids, *cols).where(F.col("_kind") != 1)
    key = ["_e", "_pd", "_v", "_td"]
    gcols = []
    if "venue" in groups or "band" in groups:
        UG = union_all([frames[kind] for kind in (0, 2, 3, 4, 5) if kind in frames])
        wG = cumulative(["_e", "_gkk", "_gk"], [DAY, SIDE])
        G = UG.select("_kind", "_e", "_pd", "_v", "_td",
                      F.sum("g_n").over(wG).alias("g_cn"), F.sum("g_s").over(wG).alias("g_cs")).where(F.col("_kind") != 2)
        # a probe for a distance has no venue: its counts belong to all probes of that entity, day and distance
        if "band" in groups:
            wb = Window.partitionBy("_e", "_pd", "_td")
            sign = F.when(F.col("_kind") == 3, 1).when(F.col("_kind") == 5, -1)
            G = (G.withColumn("b_n", F.sum(sign * F.col("g_cn")).over(wb))
                  .withColumn("b_s", F.sum(sign * F.col("g_cs")).over(wb)))
        G = G.where(F.col("_kind").isin(0, 4))
        gcols = [c for c in ("g_cn", "g_cs", "b_n", "b_s") if c in G.columns]
        # both sides are hash partitioned by entity after their windows: stack
        # them and fold per probe key (an aggregate clustered on the entity)
        W = W.unionByName(G, allowMissingColumns=True)
    if gcols or L is not None:
        at = lambda kind, c: F.first(F.when(F.col("_kind") == kind, F.col(c)), ignorenulls=True)
        zero = lambda x: F.coalesce(x, F.lit(0))

        def folded(c):
            if L is None or c.startswith(("l_", "b_", "_yr")):
                return at(0, c)
            if c == "c_vmin":
                return F.least(at(0, c), at(4, c))
            if c == "c_win":
                return F.when(at(0, c) >= F.col("_pd") - L, at(0, c))
            if c in years:
                return zero(at(0, c)) - F.when(at(4, "_yr") == at(0, "_yr"), zero(at(4, c))).otherwise(0)
            return zero(at(0, c)) - zero(at(4, c))
        states = [c for c in W.columns if c not in ids]
        W = W.groupBy(*key).agg(*[folded(c).alias(c) for c in ["_yr", *states]])
    else:
        W = W.drop("_kind")
    return W.withColumnRenamed("_pd", DAY)


def point_in_time_features(
    history: DataFrame,
    targets: DataFrame,
    *,
    entity: str = "entity_id",
    date: str = "event_date",
    venue: str = "venue_id",
    distance: str = "distance_m",
    kg: str = "load_kg",
    pos: str = "finish_pos",
    dividend: str = "dividend",
    rider: str = "rider_id",
    target_rider: str | None = None,
    tiebreak: Sequence[str] = ("contest_id", "px"),
    last_n: int = 3,
    lookback_days: int | None = None,
    band_m: int = 100,
    groups: Iterable[str] = ALL_GROUPS,
    salt_buckets: int = 64,
    contest_cols: Sequence[str] | None = None,
    reduce_history: bool = False,
) -> DataFrame:
    groups = frozenset(groups)
    if history is None:
        raise RuntimeError("history is required: features are computed against an explicit history")
    require_columns(history, [entity, date, venue, pos, kg, distance], "history")
    require_columns(targets, [entity, date, distance, venue, kg], "targets")
    k = int(last_n)
    L = None if lookback_days is None else int(lookback_days)
    if L is not None and L < 1:
        raise ValueError("a lookback has at least one day")

    H = history_rows(history, entity=entity, date=date, venue=venue, distance=distance, kg=kg, pos=pos,
                     dividend=dividend, rider=rider, tiebreak=tiebreak)

    Tgt = target_rows(targets, entity=entity, date=date, venue=venue, distance=distance, kg=kg,
                      rider=target_rider or rider)
    HR = H
    if reduce_history:
        H, HR = only_keys(H, "_e", Tgt), only_keys(H, "_r", Tgt) if "rider" in groups else H
    # Everything of an entity is dealt out once: aggregates, windows, unions and joins on the entity and more keys
    # stay where they are.
    co_partition(targets.sparkSession)
    probes = (Tgt.where(F.col("_e").isNotNull() & F.col(DAY).isNotNull())
              .select("_e", DAY, "_v", "_td").repartition("_e").distinct()
              .select("_e", DAY, F.year(F.date_from_unix_date(DAY)).alias("_yr"), "_v", "_td"))

    place = ("venue" in groups, "band" in groups)
    if L is None:
        P = _running_states(H, probes, k, None, groups, salt_buckets, band_m)
        feats = P.select(*state_features(k, None, *place))
    else:
        long = hot_keys(H, "_e", FRAME_ROWS)
        of_long = lambda rows: rows.join(long, "_e", "left_semi")
        feats = (frame_states(H.join(long, "_e", "left_anti"), probes, k, L, *place, band_m).select(*state_features(k, L, *place))
                 .unionByName(_running_states(of_long(H), of_long(probes), k, L, groups, salt_buckets, band_m).select(*state_features(k, L, *place))))

    # ------------------------------------------------ attach to the targets
    # The narrow statistics of contests and riders first: what is dealt out by entity at last meets its wide
    # features where they are.
    out = with_contest(Tgt, Tgt, contest_cols) if "contest" in groups else Tgt
    if "rider" in groups:
        # a row per rider and day, with or without history: what lies before it is strictly earlier
        rh = HR.where(F.col("_r").isNotNull()).select("_r", DAY, F.lit(1).alias("_run"), F.col("_pos").between(1, 3).alias("_show"))
        rp = Tgt.where(F.col("_r").isNotNull() & F.col(DAY).isNotNull()).select("_r", DAY, F.lit(True).alias("_asked"))
        rdays = union_all([rh, rp]).groupBy("_r", DAY).agg(
            F.count("_run").alias("r_n"), F.count_if("_show").alias("r_s"), F.max("_asked").alias("_asked"))
        wR = Window.partitionBy("_r").orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)  # Q5: never lookback-limited
        rf = (rdays.select("_r", DAY, "_asked", F.sum("r_n").over(wR).alias("cr_n"), F.sum("r_s").over(wR).alias("cr_s"))
              .where("_asked")
              .select(F.col("_r").alias("fr_r"), F.col(DAY).alias("fr_day"),
                      _count("cr_n").alias("jockey_career_runs"),
                      _rate(F.col("cr_s"), F.col("cr_n")).alias("jockey_career_show_rate")))
        out = out.join(rf, (out["_r"] == rf["fr_r"]) & (out[DAY] == rf["fr_day"]), "left")
    out = out.join(
        feats,
        (Tgt["_e"] == feats["f_e"]) & (Tgt[DAY] == feats["f_day"])
        & Tgt["_v"].eqNullSafe(feats["f_v"]) & Tgt["_td"].eqNullSafe(feats["f_td"]),
        "left")

    return contract(out, targets, Tgt, feats, rf if "rider" in groups else None, k, "contest" in groups)


def event_ordinal(df: DataFrame, entity: str, date: str, name: str = "ordinal") -> DataFrame:
    """how many rows of the entity lie on earlier days. Rows are counted by day before they are
    ranked, so an entity's window has a row per day, and rows meet their day's rank by an equi-join."""
    days = df.groupBy(entity, date).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    ranks = days.select(F.col(entity).alias("_oe"), F.col(date).alias("_od"), F.coalesce(earlier, F.lit(0)).cast("long").alias(name))
    return df.join(ranks, df[entity].eqNullSafe(ranks["_oe"]) & df[date].eqNullSafe(ranks["_od"])).drop("_oe", "_od")


def training_frame(history: DataFrame, **kw) -> DataFrame:
    """K5: the labelled history featurised against itself, with ``label``."""
    lab = history.where(F.col(kw.get("pos", "finish_pos")).isNotNull())
    if "label" not in lab.columns:
        lab = lab.withColumn("label", F.col(kw.get("pos", "finish_pos")).between(1, 3).cast("int"))
    return point_in_time_features(lab, lab, **kw)


def label_column(df: DataFrame, pos: str = "finish_pos") -> Column:
    """``label`` if present, else derived from the position, else an error."""
    if "label" in df.columns:
        return F.col("label").cast("int")
    if pos not in df.columns:
        raise KeyError("target frame needs either 'label' or a finish position column")
    return F.col(pos).between(1, 3).cast("int")
