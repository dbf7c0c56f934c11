"""Request validation and reshaping (C8-C13) as DataFrame rules.

Row rules produce an array of violated rule names (``array_compact`` of
conditional literals) instead of raising per row; group rules are grouped
aggregates joined back with a semi join. Valid and rejected rows are two
outputs of the same plan.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, norm_name

# --- fixed values: request constraints --------------------------------------
NAME_LEN = (1, 120)
KG_OPEN = (30.0, 80.0)        # exclusive bounds
POST_RANGE = (1, 25)
AGE_RANGE = (2, 20)
SEXES = ("M", "H")
DISTANCE_RANGE = (600, 4000)
TOP_K_RANGE = (1, 40)
ENTRIES_PER_CONTEST = (1, 25)
DEFAULT_DISTANCE = 1100
# --- end of fixed values -----------------------------------------------------


def entry_violations(name: Column, kg: Column, post: Column | None = None, age: Column | None = None,
                     sex: Column | None = None, distance: Column | None = None,
                     top_k: Column | None = None, rider: Column | None = None) -> Column:
    """Array of the rules an entry violates (empty = valid). Optional
    fields are only checked when present."""
    n = F.length(F.trim(name))
    rules = [
        F.when(name.isNull() | (n < NAME_LEN[0]) | (n > NAME_LEN[1]), F.lit("name_length")),
        F.when(kg.isNull() | (kg <= KG_OPEN[0]) | (kg >= KG_OPEN[1]), F.lit("kg_range")),
    ]
    if post is not None:
        rules.append(F.when(post.isNotNull() & ~post.between(*POST_RANGE), F.lit("post_range")))
    if age is not None:
        rules.append(F.when(age.isNotNull() & ~age.between(*AGE_RANGE), F.lit("age_range")))
    if sex is not None:
        rules.append(F.when(sex.isNotNull() & ~sex.isin(*SEXES), F.lit("sex_code")))
    if distance is not None:
        rules.append(F.when(distance.isNull() | ~distance.between(*DISTANCE_RANGE), F.lit("distance_range")))
    if rider is not None:
        rules.append(F.when(F.length(rider) > NAME_LEN[1], F.lit("rider_length")))
    if top_k is not None:
        rules.append(F.when(top_k.isNotNull() & ~top_k.between(*TOP_K_RANGE), F.lit("top_k_range")))
    return F.array_compact(F.array(*rules))


def group_check(df: DataFrame, contest: Sequence[str], name: str) -> DataFrame:
    """Per contest, entry count within 1..25 and names unique after
    normalisation. A grouped aggregate (partial), one row per contest."""
    return (df.groupBy(*contest).agg(F.count(F.lit(1)).alias("n_entries"),
                                     F.count_distinct(norm_name(F.col(name))).alias("n_names"))
            .withColumn("group_ok", F.col("n_entries").between(*ENTRIES_PER_CONTEST)
                        & (F.col("n_names") == F.col("n_entries"))))


def split_valid(df: DataFrame, contest: Sequence[str], name: str, violations: Column):
    """(valid rows, rejects). A contest is one request: a bad entry, or a bad
    group, rejects all of it. Rejects keep their own reasons; the other rows of
    their contest have ``group_rule`` or ``contest_rejected``."""
    tagged = df.withColumn("_viol", violations)
    groups = (tagged.groupBy(*contest)
              .agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(norm_name(F.col(name))).alias("_names"),
                   F.count_if(F.size("_viol") > 0).alias("_bad"))
              .withColumn("_group_ok", F.col("_n").between(*ENTRIES_PER_CONTEST) & (F.col("_names") == F.col("_n"))))
    judged = tagged.join(groups.select(*contest, "_bad", "_group_ok"), list(contest))
    ok = F.col("_group_ok") & (F.col("_bad") == 0)
    reasons = (F.when(F.size("_viol") > 0, F.col("_viol"))
               .when(~F.col("_group_ok"), F.array(F.lit("group_rule"))).otherwise(F.array(F.lit("contest_rejected"))))
    valid = judged.where(ok).select(*df.columns)
    rejects = judged.where(~ok).select(*df.columns, reasons.alias("violations"))
    return valid, rejects


def default_fill(d: Column, default: int = DEFAULT_DISTANCE) -> Column:
    """Distance 0 or NULL -> default (for features); keep the source too."""
    return F.coalesce(F.nullif(d, F.lit(0)), F.lit(default))


def clean_form_rows(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Trim text cells, blank -> NULL, drop rows without a name."""
    out = df.select(*[blank_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    return out.where(F.col(name).isNotNull())


def flatten_cards(cards: DataFrame, context: Sequence[str], entries: str = "entries") -> DataFrame:
    """Nested (context + entries) -> one target row per entry, entry order
    kept as ``entry_pos`` (0-based)."""
    return cards.select(*context, F.posexplode(entries).alias("entry_pos", "_e")).select(
        *context, "entry_pos", "_e.*")


def nest_results(scored: DataFrame, contest: Sequence[str], entry_cols: Sequence[str],
                 order: str = "rank") -> DataFrame:
    """C11: one nested record per contest with its entries sorted by ``order``.
    A contest is a request of at most 25 entries (C9) or a contest of a day card,
    a bounded block of one sheet."""
    packed = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in entry_cols])
    return (scored.groupBy(*contest)
            .agg(F.sort_array(F.collect_list(packed)).alias("_es"), F.count(F.lit(1)).alias("n_entries"))
            .select(*contest, "n_entries",
                    F.transform("_es", lambda e: e.dropFields("_o")).alias("entries")))
