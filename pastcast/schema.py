"""Fixed output contract of the point-in-time feature job.

The names and their order are values that must equal the reference model
contract, so they are listed here verbatim, as fixed values.
"""
from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: feature contract (names and order) -----------------------
NUMERIC_FEATURES = [
    "horse_age",
    "weight_kg",
    "weight_kg_zscore_in_race",
    "rest_days",
    "career_runs",
    "career_wins",
    "career_places",
    "career_shows",
    "career_win_rate",
    "career_show_rate",
    "year_runs",
    "year_wins",
    "year_places",
    "year_shows",
    "year_win_rate",
    "year_show_rate",
    "last_finish_pos",
    "avg_finish_last3",
    "best_finish_last3",
    "n_field",
    "post_position",
    "track_runs",
    "track_show_rate",
    "dist_bucket_runs",
    "dist_bucket_show_rate",
    "days_since_last_win",
    "dividend_career_mean",
    "dividend_last3_mean",
    "dividend_career_min",
    "dist_diff_from_avg",
    "weight_change_from_last",
    "jockey_career_runs",
    "jockey_career_show_rate",
]
CATEGORICAL_FEATURES = ["sex_code", "racetrack_id"]
# --- end of fixed values -----------------------------------------------------

ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# Spark types of the contract. Counts are BIGINT, categorical codes keep their
# natural type, everything else is DOUBLE (missing = NULL, never NaN).
COUNT_FEATURES = {
    "career_runs", "career_wins", "career_places", "career_shows",
    "year_runs", "year_wins", "year_places", "year_shows",
    "track_runs", "dist_bucket_runs", "jockey_career_runs", "n_field",
}
INT_FEATURES = {"horse_age", "post_position", "racetrack_id"}
STRING_FEATURES = {"sex_code"}


def feature_type(name: str) -> T.DataType:
    if name in COUNT_FEATURES:
        return T.LongType()
    if name in INT_FEATURES:
        return T.IntegerType()
    if name in STRING_FEATURES:
        return T.StringType()
    return T.DoubleType()


def feature_sql_type(name: str) -> str:
    return {T.LongType(): "BIGINT", T.IntegerType(): "INTEGER",
            T.StringType(): "VARCHAR", T.DoubleType(): "DOUBLE"}[feature_type(name)]


def last_n_names(n: int) -> tuple[str, str]:
    """Q2: the rolling size only changes the suffix when it is not 3."""
    return f"avg_finish_last{n}", f"best_finish_last{n}"


# Explicit schema of the long-form history (A1 reads with it, no inference).
HISTORY_SCHEMA = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("rider_id", T.LongType()),
    T.StructField("contest_id", T.LongType()),
    T.StructField("px", T.DoubleType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("venue_id", T.IntegerType()),
    T.StructField("distance_m", T.IntegerType()),
    T.StructField("load_kg", T.DoubleType()),
    T.StructField("finish_pos", T.IntegerType()),
    T.StructField("dividend", T.DoubleType()),
])
