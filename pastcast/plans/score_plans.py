"""Registered scoring, validation, nesting and explanation queries (L1-L4,
C8-C13, F10, G1-G4, D10, E26, K8a) — exact oracles via the fixed linear scorer."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score as SC
from ..operators import validate as V
from ..operators.features import point_in_time_features
from ..sources.tables import HISTORY_SQL, history, table
from .feature_plans import features_sql, rounded, score_binding, score_features
from .registry import register

M = SC.DEMO_SCORER
CONTEST = ["contest_id"]


def _z_sql(prefix: str = "") -> str:
    z = f"CAST({M.intercept} AS DOUBLE)"
    for c, w in M.coef.items():
        z = f"({z} + CAST({w} AS DOUBLE) * coalesce(CAST({prefix}{c} AS DOUBLE), CAST({M.center[c]} AS DOUBLE)))"
    return z


VIOL_SQL = """list_filter([
  CASE WHEN length(trim(CAST(entity_id AS VARCHAR))) NOT BETWEEN 1 AND 120 THEN 'name_length' END,
  CASE WHEN load_kg IS NULL OR load_kg <= 30 OR load_kg >= 80 THEN 'kg_range' END,
  CASE WHEN post_position IS NOT NULL AND post_position NOT BETWEEN 1 AND 25 THEN 'post_range' END,
  CASE WHEN horse_age IS NOT NULL AND horse_age NOT BETWEEN 2 AND 20 THEN 'age_range' END,
  CASE WHEN sex_code IS NOT NULL AND sex_code NOT IN ('M', 'H') THEN 'sex_code' END,
  CASE WHEN distance_m IS NULL OR distance_m NOT BETWEEN 600 AND 4000 THEN 'distance_range' END
], lambda x: x IS NOT NULL)"""

SCORED_SQL = f"""
WITH v AS ({features_sql('score_valid', rnd=False)}),
s AS (SELECT v.*, 1.0 / (1.0 + exp(-{_z_sql()})) AS p FROM v)
"""


def split_requests(targets):
    """C8/C9 on the raw targets, each contest one request: (valid, rejects)."""
    viol = V.entry_violations(F.col("entity_id").cast("string"), F.col("load_kg"), F.col("post_position"),
                              F.col("horse_age"), F.col("sex_code"), F.col("distance_m"),
                              rider=F.col("rider_id").cast("string"))
    named = targets.withColumn("name", F.col("entity_id").cast("string"))
    valid, rejects = V.split_valid(named, CONTEST, "name", viol)
    return valid.drop("name"), rejects.drop("name")


def scored_targets(spark, sf_dir):
    """L1: validate requests -> features of each contest against the frozen history -> p."""
    frozen, targets = score_binding(spark, sf_dir)
    valid, _ = split_requests(targets)
    return M(point_in_time_features(frozen, valid, contest_cols=CONTEST, reduce_history=True))


# A binding in which every entry rule has rows on both sides.
ODD_ENTRIES_SQL = f"""
WITH r AS (SELECT contest_id, px, entity_id, 20 + (load_kg - 40) * 2.6 AS load_kg,
                  CAST(entity_id % 29 AS INTEGER) AS post_position, CAST(entity_id % 23 AS INTEGER) AS horse_age,
                  CASE WHEN entity_id % 13 = 0 THEN 'X' WHEN entity_id % 7 = 0 THEN NULL ELSE 'M' END AS sex_code,
                  CASE WHEN contest_id % 11 = 0 THEN NULL ELSE CAST((contest_id % 45) * 100 AS INTEGER) END AS distance_m
           FROM ({HISTORY_SQL}) h),
t AS (SELECT r.*, {VIOL_SQL} AS viol FROM r)
"""


def odd_entries(spark, sf_dir):
    e, c = F.col("entity_id"), F.col("contest_id")
    return history(spark, sf_dir).select(
        "contest_id", "px", "entity_id", "rider_id", (F.lit(20.0) + (F.col("load_kg") - 40) * 2.6).alias("load_kg"),
        (e % 29).cast("int").alias("post_position"), (e % 23).cast("int").alias("horse_age"),
        F.when(e % 13 == 0, "X").when(e % 7 == 0, F.lit(None)).otherwise("M").alias("sex_code"),
        F.when(c % 11 == 0, F.lit(None)).otherwise((c % 45) * 100).cast("int").alias("distance_m"))


@register("score_batch_sql", SCORED_SQL + """
SELECT contest_id, px, entity_id, round(p, 6) AS p,
       row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank FROM s
""")
def _score_batch(spark, sf_dir):
    s = SC.rank_in_contest(scored_targets(spark, sf_dir), CONTEST, "p", ["px"])
    return rounded(s.select("contest_id", "px", "entity_id", "p", F.col("rank").cast("long")))


@register("rank_in_contest", SCORED_SQL + """
SELECT contest_id, px, row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank FROM s
""")
def _rank_in_contest(spark, sf_dir):
    s = SC.rank_in_contest(scored_targets(spark, sf_dir), CONTEST, "p", ["px"])
    return s.select("contest_id", "px", F.col("rank").cast("long"))


@register("contest_topn", SCORED_SQL + """
SELECT * FROM (SELECT contest_id, px, entity_id, round(p, 6) AS p,
                      row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank FROM s) x
WHERE rank <= 3
""")
def _contest_topn(spark, sf_dir):
    s = SC.rank_in_contest(scored_targets(spark, sf_dir), CONTEST, "p", ["px"])
    return rounded(SC.contest_topn(s, 3).select("contest_id", "px", "entity_id", "p",
                                                F.col("rank").cast("long")))


@register("ordered_output", SCORED_SQL + """
SELECT contest_id, px, round(p, 6) AS p FROM s ORDER BY p DESC, contest_id, px
""")
def _ordered_output(spark, sf_dir):
    s = scored_targets(spark, sf_dir)
    return rounded(s.select("contest_id", "px", "p").orderBy(F.col("p").desc(), "contest_id", "px"))


@register("argmax_row", SCORED_SQL + """
SELECT contest_id, px, entity_id, round(p, 6) AS p FROM s ORDER BY p DESC, contest_id, px LIMIT 1
""")
def _argmax_row(spark, sf_dir):
    s = scored_targets(spark, sf_dir).select("contest_id", "px", "entity_id", "p")
    return rounded(SC.argmax_row(s, "p", ["contest_id", "px"]))


@register("rank_lookup", SCORED_SQL + """
SELECT contest_id, px, row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank,
       row_number() OVER (PARTITION BY contest_id ORDER BY px) AS entry_pos FROM s
ORDER BY contest_id, entry_pos
""")
def _rank_lookup(spark, sf_dir):
    from pyspark.sql.window import Window
    s = SC.rank_in_contest(scored_targets(spark, sf_dir), CONTEST, "p", ["px"])
    s = s.withColumn("entry_pos", F.row_number().over(Window.partitionBy(*CONTEST).orderBy("px")))
    return s.select("contest_id", "px", F.col("rank").cast("long"), F.col("entry_pos").cast("long")) \
            .orderBy("contest_id", "entry_pos")


@register("score_single", f"""
WITH f AS ({features_sql('score', rnd=False)})
SELECT contest_id, px, CAST(NULL AS DOUBLE) AS weight_kg_zscore_in_race, CAST(1 AS BIGINT) AS n_field,
       round(1.0 / (1.0 + exp(-{_z_sql().replace('weight_kg_zscore_in_race', 'NULL')})), 6) AS p
FROM f
""")
def _score_single(spark, sf_dir):
    # each entry is its own contest: z-score missing, field size 1 (Q8)
    f = score_features(spark, sf_dir, contest_cols=["contest_id", "px"])
    return rounded(M(f).select("contest_id", "px", "weight_kg_zscore_in_race", "n_field", "p"))


def _contrib_sql(src: str) -> str:
    parts = []
    for c, w in M.coef.items():
        parts.append(f"SELECT contest_id, px, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
                     f"CAST({w} AS DOUBLE) * (coalesce(CAST({c} AS DOUBLE), CAST({M.center[c]} AS DOUBLE)) "
                     f"- CAST({M.center[c]} AS DOUBLE)) AS contribution FROM {src}")
    return " UNION ALL ".join(parts)


@register("explain_rows", SCORED_SQL + f"""
, c AS ({_contrib_sql('s')})
SELECT contest_id, px, feature, round(value, 6) AS value, round(contribution, 6) AS contribution,
       round({M.base_value()}, 6) AS base_value FROM c
""")
def _explain_rows(spark, sf_dir):
    s = scored_targets(spark, sf_dir)
    return rounded(M.contributions(s, ["contest_id", "px"]))


@register("explain_topk", SCORED_SQL + f"""
, c AS ({_contrib_sql('s')}),
k AS (SELECT *, row_number() OVER (PARTITION BY contest_id, px ORDER BY abs(contribution) DESC, feature) AS k FROM c)
SELECT contest_id, px, feature, round(value, 6) AS value, round(contribution, 6) AS contribution,
       round({M.base_value()}, 6) AS base_value, k FROM k WHERE k <= 3
""")
def _explain_topk(spark, sf_dir):
    s = scored_targets(spark, sf_dir)
    c = M.contributions(s, ["contest_id", "px"])
    return rounded(SC.topk_contributions(c, ["contest_id", "px"], 3).withColumn("k", F.col("k").cast("long")))


@register("mean_abs_contribution", SCORED_SQL + f"""
, c AS ({_contrib_sql('s')})
SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM c GROUP BY feature
""")
def _mean_abs(spark, sf_dir):
    c = M.contributions(scored_targets(spark, sf_dir), ["contest_id", "px"])
    return rounded(c.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")))


@register("validate_entries", ODD_ENTRIES_SQL + """
SELECT contest_id, px, len(viol) = 0 AS valid, array_to_string(viol, ',') AS violations FROM t
""")
def _validate_entries(spark, sf_dir):
    f = odd_entries(spark, sf_dir)
    viol = V.entry_violations(F.col("entity_id").cast("string"), F.col("load_kg"), F.col("post_position"),
                              F.col("horse_age"), F.col("sex_code"), F.col("distance_m"))
    return f.select("contest_id", "px", (F.size(viol) == 0).alias("valid"),
                    F.array_join(viol, ",").alias("violations"))


@register("validate_group", f"""
WITH r AS ({HISTORY_SQL})
SELECT contest_id, count(*) AS n_entries, count(DISTINCT entity_id % 5) AS n_names,
       (count(*) BETWEEN 1 AND 25 AND count(DISTINCT entity_id % 5) = count(*)) AS group_ok FROM r GROUP BY contest_id
""")
def _validate_group(spark, sf_dir):
    # names that meet in many contests: entity % 5
    f = history(spark, sf_dir).select("contest_id", (F.col("entity_id") % 5).cast("string").alias("name"))
    return V.group_check(f, CONTEST, "name").select("contest_id", "n_entries", "n_names", "group_ok")


@register("score_rejects", ODD_ENTRIES_SQL + """
, g AS (SELECT contest_id, count(*) FILTER (WHERE len(viol) > 0) AS bad,
               count(*) BETWEEN 1 AND 25 AND count(DISTINCT entity_id) = count(*) AS ok FROM t GROUP BY contest_id)
SELECT t.contest_id, t.px, CASE WHEN len(viol) > 0 THEN array_to_string(viol, ',')
                                WHEN NOT ok THEN 'group_rule' ELSE 'contest_rejected' END AS violations
FROM t JOIN g ON t.contest_id = g.contest_id WHERE bad > 0 OR NOT ok
""")
def _score_rejects(spark, sf_dir):
    _, rejects = split_requests(odd_entries(spark, sf_dir))
    return rejects.select("contest_id", "px", F.array_join("violations", ",").alias("violations"))


@register("nest_results", SCORED_SQL + """
, rk AS (SELECT contest_id, px, entity_id, p,
                row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank,
                count(*) OVER (PARTITION BY contest_id) AS n_entries FROM s)
SELECT contest_id, n_entries, rank - 1 AS entry_pos, entity_id, round(p, 6) AS p, rank FROM rk
""")
def _nest_results(spark, sf_dir):
    # nest (C11) then flatten (C10): the round trip must give every entry back
    s = SC.rank_in_contest(scored_targets(spark, sf_dir), CONTEST, "p", ["px"])
    nested = V.nest_results(s, CONTEST, ["entity_id", "p", "rank"], order="rank")
    flat = V.flatten_cards(nested, ["contest_id", "n_entries"], "entries")
    return rounded(flat.select("contest_id", "n_entries", F.col("entry_pos").cast("int"), "entity_id", "p",
                               F.col("rank").cast("long")))


@register("flatten_cards", """
SELECT conv_id, turn AS entry_pos, role, length(text) AS n_chars FROM conversations
""")
def _flatten_cards(spark, sf_dir):
    # nested cards (context + ordered turns, at most 25 turns per card so every
    # collected array is bounded; a long conversation spans several cards)
    # -> one row per turn
    cv = table(spark, sf_dir, "conversations").withColumn("card", F.floor(F.col("turn") / 25))
    cards = cv.groupBy("conv_id", "card").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("entries"))
    flat = V.flatten_cards(cards, ["conv_id", "card"])
    return flat.select("conv_id", F.col("turn").alias("entry_pos"), "role",
                       F.length("text").alias("n_chars"))


@register("default_fill", f"""
WITH r AS ({HISTORY_SQL}),
d AS (SELECT contest_id, px, CASE WHEN contest_id % 7 = 0 THEN 0 WHEN contest_id % 11 = 0 THEN NULL ELSE distance_m END
             AS distance_m FROM r)
SELECT contest_id, px, coalesce(nullif(distance_m, 0), 1100) AS distance_used_m, distance_m FROM d
""")
def _default_fill(spark, sf_dir):
    c = F.col("contest_id")
    t = history(spark, sf_dir).withColumn("distance_m", F.when(c % 7 == 0, 0).when(c % 11 == 0, F.lit(None))
                                          .otherwise(F.col("distance_m")).cast("int"))
    return t.select("contest_id", "px", V.default_fill(F.col("distance_m")).alias("distance_used_m"), "distance_m")


@register("clean_form_rows", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_rows FROM l WHERE nullif(trim(line), '') IS NOT NULL GROUP BY doc_id
""")
def _clean_form_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return V.clean_form_rows(lines, ["line"], "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
