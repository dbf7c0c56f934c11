"""Report grids -> rows (B1-B20), as distributed jobs over a cell table
``cells(file STRING, row INT, cells ARRAY<STRING>)`` (A16).

The workbook decoder itself is not rebuilt: a grid arrives as rows of string
cells and every parsing step is a DataFrame expression. Segmentation
(gaps-and-islands: "rows between two leader rows form a block") is
``segment``: files of at most CHUNK rows are a window each. The rows of larger
ones are cut into fixed-size chunks by their number; a window per
(file, chunk) finds the last start inside the chunk and a window over the
per-chunk summaries carries the last start across chunk
borders. No window of rows ever spans a huge file, so it is never one task.
What later steps need of a row's cells is read before rows are dealt out, so that no shuffle carries the cells.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import (age_at_event, int_cell, norm_name, numeric_cell, parse_ddmmyy,
                                 time_to_seconds)

CHUNK = 1 << 16

# --- fixed values: report layout and vocabularies ---------------------------
# 0-based column offsets of the per-entity history table in the report grid
COL_DATE = 1
COL_VENUE_ABBR = 4
COL_POS = 6
COL_WINNER = 7
COL_KG = 18
COL_DISTANCE = 22
COL_TIME = 25
COL_DIVIDEND = 28
COL_RIDER = 30
COL_BODY_WEIGHT = 33
# leader row: col 1 post position 1..25, col 4 name, col 30 kg 40..70
LEADER_POS_COL, LEADER_NAME_COL, LEADER_KG_COL = 1, 4, 30
HEADER_WORD = "fecha"
AGE_COLS = (10, 11, 12)
AGE_SCAN_ROWS = 12
AGE_PATTERN = r"^\s*(\d{1,2})\s*a\.?\s*$"
SEX_PATTERN = r"^\s*([mMhH])\.?\s*$"
POS_PATTERN = r"^\s*(\d{1,2})\s*$"
# venue abbreviation -> venue id
VENUE_ABBR = {
    "MRÑ": 1, "MRN": 1, "MRO": 1, "MAR": 1,
    "L.PD": 13, "LPD": 13, "L PD": 13, "L.P": 13,
    "COL": 4, "MEL": 16, "PAY": 21, "FLD": 9, "RCO": 22, "FLS": 8,
}
# day card: contest header marker (col 7), start time (col 25), entry columns
CARD_HEADER = "PREMIO:"
CARD_HEADER_COL = 7
CARD_TIME_COL = 25
CARD_TIME_PATTERN = r"^\d{1,2}:\d{2}$"
CARD_TIME_LOOKBACK = 5
CARD_POST_COL, CARD_NAME_COL, CARD_KG_COL = 0, 2, 11
CARD_SEX_COL, CARD_AGE_COL, CARD_RIDER_COL = 14, 15, 16
# distance readings: "1100 mts", "(2000mts)", "1.600 mt"; valid 800..3000
DISTANCE_PATTERN = r"(?i)(\d{3,4})\s*mt"
DISTANCE_RANGE = (800, 3000)
# file name of a report: <Type>_RT<venue>_<yyyymmdd>.xls
DOC_NAME_PATTERN = r"^([A-Za-z]+)_RT(\d+)_(\d{8})\.xls$"
# --- end of fixed values -----------------------------------------------------


def cell(i: int, col: str = "cells") -> Column:
    """Cell ``i`` (0-based) as trimmed text; missing cell -> NULL."""
    return F.get(F.col(col), F.lit(i))


def segment(df: DataFrame, part: Sequence[str], order: str, is_start: Column,
            chunk: int = CHUNK) -> DataFrame:
    """Gaps-and-islands: adds ``seg_start`` (``order`` value of the last start
    row at or before this row; NULL before the first start) and ``seg_no``
    (1-based number of that start within ``part``). Rows without ``part`` or ``order`` go; starts
    without ``order`` count as the first ones."""
    d = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in part])).withColumn("_st", is_start)
    # at most one part for so many rows: few enough to be sent to every task
    large = d.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).select(*part, F.lit(True).alias("_big"))
    d = d.join(F.broadcast(large), list(part), "left").withColumn(
        "_ck", F.when(F.col("_big"), F.floor(F.col(order) / chunk)).otherwise(F.lit(0).cast("long")))
    wi = (Window.partitionBy(*part, "_ck").orderBy(order)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summ = d.where("_big").groupBy(*part, "_ck").agg(F.max(F.when(F.col("_st"), F.col(order))).alias("_cl"),
                                                     F.count_if(F.col("_st")).alias("_cn"))
    d = d.withColumn("_ls", F.max(F.when(F.col("_st"), F.col(order))).over(wi)) \
         .withColumn("_ln", F.sum(F.when(F.col("_st"), 1).otherwise(0)).over(wi))
    wc = Window.partitionBy(*part).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*part, "_ck", F.max("_cl").over(wc).alias("_prev"), F.sum("_cn").over(wc).alias("_off"))
    out = d.where(F.col(order).isNotNull()).join(summ, [*part, "_ck"], "left")
    return (out.withColumn("seg_start", F.coalesce(F.col("_ls"), F.col("_prev")))
            .withColumn("seg_no", F.when(F.col("seg_start").isNotNull(), F.coalesce(F.col("_off"), F.lit(0)) + F.col("_ln")))
            .drop("_st", "_big", "_ck", "_ls", "_ln", "_prev", "_off"))


def is_leader(col: str = "cells") -> Column:
    """B1/Q23: col 1 an integer 1..25, col 4 non-blank text, col 30 a number in 40..70."""
    # the column of the dates: a date is no number, and a cast that fails takes long
    pos = F.when(~F.contains(cell(LEADER_POS_COL, col), F.lit("/")), cell(LEADER_POS_COL, col)).try_cast("double")
    name = F.trim(cell(LEADER_NAME_COL, col))
    kg = cell(LEADER_KG_COL, col).try_cast("double")
    return (F.coalesce(name != "", F.lit(False))
            & F.coalesce(pos.cast("int").between(1, 25), F.lit(False))
            & F.coalesce(kg.between(40, 70), F.lit(False)))


def blocks(cells: DataFrame, leader: Column | None = None) -> DataFrame:
    """B2: rows tagged with their block (``block_row`` = leader row); rows before
    the first leader are dropped."""
    seg = segment(cells, ["file"], "row", leader if leader is not None else is_leader())
    return seg.where(F.col("seg_start").isNotNull()).withColumnRenamed("seg_start", "block_row") \
              .withColumnRenamed("seg_no", "block_no")


def header_cells() -> dict[str, Column]:
    """What ``block_headers`` reads of a row's cells."""
    return {"_header": F.lower(F.trim(cell(COL_DATE))) == HEADER_WORD, "_name": F.trim(cell(LEADER_NAME_COL)),
            "_post": cell(LEADER_POS_COL).try_cast("double").cast("int")}


def block_headers(blk: DataFrame) -> DataFrame:
    """Per block the name (leader col 4) and the first header row; blocks
    without a header or with a blank name are dropped. Rows have ``cells`` or the ``header_cells``."""
    if "_header" not in blk.columns:
        blk = blk.withColumns(header_cells())
    leads = F.col("row") == F.col("block_row")
    return (blk.groupBy("file", "block_row", "block_no").agg(
        F.min(F.when(F.col("_header"), F.col("row"))).alias("header_row"),
        F.max(F.when(leads, F.col("_name"))).alias("name"),
        F.max(F.when(leads, F.col("_post"))).alias("post_position"))
        .where(F.col("header_row").isNotNull() & F.col("name").isNotNull() & (F.col("name") != "")))


def age_cell() -> dict[str, Column]:
    """What ``block_meta`` reads of a row's cells: (age, sex) of the first age cell, NULL without one."""
    text = lambda c: F.coalesce(cell(c), F.lit(""))
    said = []
    for c in AGE_COLS:
        age = F.regexp_extract(text(c), AGE_PATTERN, 1)
        sex1, sex2 = (F.regexp_extract(text(c - i), SEX_PATTERN, 1) for i in (1, 2))
        sex = F.upper(F.nullif(F.when(sex1 != "", sex1).otherwise(sex2), F.lit("")))
        said.append(F.when(age != "", F.struct(age.cast("int").alias("age"), sex.alias("sex"))))
    return {"_said": F.coalesce(*said)}


def block_meta(blk: DataFrame) -> DataFrame:
    """First age cell ``N a.`` in the 11 rows below the leader (cols 10-12,
    row-major), sex one then two cells to its left. Rows have ``cells`` or the ``age_cell``."""
    if "_said" not in blk.columns:
        blk = blk.withColumns(age_cell())
    near = blk.where((F.col("row") > F.col("block_row"))
                     & (F.col("row") < F.col("block_row") + AGE_SCAN_ROWS) & F.col("_said").isNotNull())
    return near.groupBy("file", "block_row").agg(F.min_by("_said", "row").alias("m")).select(
        "file", "block_row", F.col("m.age").alias("horse_age"), F.col("m.sex").alias("sex_code"))


def venue_dim(spark) -> DataFrame:
    """The fixed abbreviation dimension (a few rows: broadcast-safe)."""
    return spark.createDataFrame(sorted(VENUE_ABBR.items()), "venue_abbr STRING, venue_id INT")


def doc_date(file: Column) -> Column:
    """Report date from ``..._yyyymmdd.xls``; impossible dates -> NULL."""
    ymd = F.regexp_extract(file, r"_(\d{8})\.xls$", 1)
    return F.when(ymd != "", F.try_to_date(ymd, "yyyyMMdd"))


def parse_grid(cells: DataFrame):
    """B1-B13 + A10: cell grid -> (rows, rejects, file_metrics).

    ``rows`` follows the long-form history schema; ``rejects`` keeps every
    data row that did not parse, with a reason; ``file_metrics`` has per-file
    blocks / history rows / skipped counters. A bad row never fails the job.
    """
    spark = cells.sparkSession
    # a column for each cell: what a cell is made of is worked out once, not for each step that reads it
    width = range(max(COL_BODY_WEIGHT, LEADER_KG_COL, *AGE_COLS) + 1)
    apart = cells.select("file", "row", *[cell(i).alias(f"_c{i}") for i in width]).withColumn("cells", F.array(*[f"_c{i}" for i in width]))
    pos_txt = F.regexp_extract(F.coalesce(cell(COL_POS), F.lit("")), POS_PATTERN, 1)
    read = apart.select(
        "file", "row", is_leader().alias("_leads"), *[c.alias(n) for n, c in (header_cells() | age_cell()).items()],
        parse_ddmmyy(cell(COL_DATE)).alias("event_date"), F.trim(cell(COL_VENUE_ABBR)).alias("venue_abbr"),
        F.when(pos_txt != "", pos_txt.try_cast("int")).alias("finish_pos"),
        F.trim(cell(COL_WINNER)).alias("winner_name"),
        numeric_cell(cell(COL_KG)).alias("load_kg"),
        int_cell(cell(COL_DISTANCE)).alias("distance_m"),
        time_to_seconds(cell(COL_TIME)).alias("total_time_s"),
        numeric_cell(cell(COL_DIVIDEND)).alias("dividend"),
        norm_name(F.coalesce(cell(COL_RIDER), F.lit(""))).alias("rider_id"),
        numeric_cell(cell(COL_BODY_WEIGHT)).alias("body_weight_kg"))
    blk = blocks(read, F.col("_leads"))
    hdr = block_headers(blk)
    meta = block_meta(blk)
    data = (blk.drop("_leads", "_header", "_name", "_post", "_said").join(hdr, ["file", "block_row", "block_no"])
            .where(F.col("row") > F.col("header_row")))
    parsed = data.join(meta, ["file", "block_row"], "left")
    ok = parsed.where(F.col("event_date").isNotNull())
    rejects = parsed.where(F.col("event_date").isNull()).select(
        "file", "row", F.lit("no_date").alias("reason"))
    dim = venue_dim(spark)
    rows = (ok.join(F.broadcast(dim), "venue_abbr", "left").select(
        norm_name("name").alias("entity_id"), "event_date", "venue_id", "venue_abbr", "finish_pos",
        F.col("finish_pos").between(1, 3).cast("int").alias("label"),
        "winner_name", "load_kg", "distance_m", "total_time_s", "dividend", "rider_id",
        "body_weight_kg", F.col("file").alias("source_file"), F.col("row").alias("source_row"),
        "sex_code",
        age_at_event(F.col("horse_age"), F.year(doc_date(F.col("file"))), F.year("event_date"))
        .alias("horse_age"),
        F.lit(None).cast("int").alias("post_position")))
    nb = hdr.groupBy("file").agg(F.count(F.lit(1)).alias("n_blocks"))
    nd = data.groupBy("file").agg(F.count("event_date").alias("n_history"), F.count_if(F.col("event_date").isNull()).alias("n_skipped"))
    files = cells.select("file").distinct()
    metrics = (files.join(nb, "file", "left").join(nd, "file", "left")
               .fillna(0, ["n_blocks", "n_history", "n_skipped"]))
    return rows, rejects, metrics


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key tuple (NULL keys compare equal), the first in
    ``order``. Implemented as ``min(struct(order..., row))`` per group — a
    partial aggregate, so a huge key group is merged map-side, never sorted
    in one task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      F.struct(*rest).alias("_row"))
    return (df.groupBy(*keys).agg(F.min(packed).alias("_m"))
            .select(*keys, "_m._row.*").select(*df.columns))


# ------------------------------------------------------------------ day cards
def card_contests(cells: DataFrame, header: str = CARD_HEADER) -> DataFrame:
    """Contest headers (col 7 starting with ``PREMIO:``) split the
    sheet; 1-based contest index per file; start time = the first (topmost)
    ``HH:MM`` cell of col 25 in the 5 rows above the header or on it."""
    hcell = F.upper(F.trim(F.coalesce(cell(CARD_HEADER_COL), F.lit(""))))
    seg = segment(cells, ["file"], "row", hcell.startswith(header))
    seg = seg.where(F.col("seg_start").isNotNull())
    # look-back as an equi-join: each header probes rows h-5..h (6 rows)
    hdr = seg.where(F.col("row") == F.col("seg_start")).select(
        "file", F.col("row").alias("header_row"),
        F.explode(F.sequence(F.col("row") - CARD_TIME_LOOKBACK, F.col("row"))).alias("row"))
    tcell = F.trim(cell(CARD_TIME_COL))
    times = cells.where(tcell.rlike(CARD_TIME_PATTERN)).select("file", "row", tcell.alias("t"))
    start = (hdr.join(times, ["file", "row"]).groupBy("file", "header_row")
             .agg(F.min_by("t", "row").alias("start_time")))
    return (seg.select("file", "row", "cells", F.col("seg_no").alias("contest_no"),
                       F.col("seg_start").alias("header_row"))
            .join(start, ["file", "header_row"], "left"))


def entry_rows(contests: DataFrame) -> DataFrame:
    """Entries below a header: post ``1a`` -> 1 (digits first), a
    non-blank name, kg a number in 40..70, sex ``m...`` -> M and any other
    non-blank -> H, age digits, rider trimmed."""
    post_txt = F.regexp_extract(F.trim(F.coalesce(cell(CARD_POST_COL), F.lit(""))), r"^(\d+)", 1)
    kg = F.trim(cell(CARD_KG_COL)).try_cast("double")
    sx = F.lower(F.trim(F.coalesce(cell(CARD_SEX_COL), F.lit(""))))
    sex = F.when(sx == "", F.lit(None)).when(sx.startswith("m"), F.lit("M")).otherwise(F.lit("H"))
    age_txt = F.trim(F.coalesce(cell(CARD_AGE_COL), F.lit("")))
    age = F.when(age_txt.rlike(r"^\d+(\.0+)?$"), age_txt.try_cast("double").cast("int"))
    name = F.trim(cell(CARD_NAME_COL))
    rider = F.nullif(F.trim(F.coalesce(cell(CARD_RIDER_COL), F.lit(""))), F.lit(""))
    ent = contests.where(F.col("row") > F.col("header_row")).select(
        "file", "contest_no", "row",
        F.when(post_txt != "", post_txt.try_cast("int")).alias("post_position"),
        name.alias("entity_name"), kg.alias("kg"), sex.alias("sex_code"),
        age.alias("horse_age"), rider.alias("rider_name"))
    return ent.where(F.col("post_position").isNotNull() & F.col("entity_name").isNotNull()
                     & (F.col("entity_name") != "") & F.col("kg").between(40, 70))


def ordinal_zip(contests: DataFrame, distances: DataFrame, default: int = 0) -> DataFrame:
    """K-th contest of a file gets the k-th distance of the file's list;
    a short list is padded with ``default``, a long one truncated."""
    c = contests.select("file", "contest_no").distinct()
    w = Window.partitionBy("file").orderBy("seq")
    d = distances.select("file", F.row_number().over(w).alias("contest_no"), "distance_m")
    return (c.join(d, ["file", "contest_no"], "left")
            .select("file", "contest_no", F.coalesce("distance_m", F.lit(default)).alias("distance_m")))


def modal_vote(readings: DataFrame, key: Sequence[str], seq: str, text: str,
               pattern: str = DISTANCE_PATTERN, lo: int = DISTANCE_RANGE[0],
               hi: int = DISTANCE_RANGE[1]) -> DataFrame:
    """Every candidate number of every reading, kept if in [lo, hi]; the
    most frequent per key wins, ties -> first seen; no candidate -> NULL.
    Candidates are reduced by (key, value) aggregation (partial, skew-safe)."""
    cand = readings.select(*key, seq, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))
                           .alias("k", "v"))
    cand = cand.select(*key, seq, "k", F.col("v").try_cast("int").alias("v")).where(F.col("v").between(lo, hi))
    votes = cand.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("votes"),
                                        F.min(F.struct(seq, "k")).alias("first_seen"))
    best = votes.groupBy(*key).agg(F.min_by(F.struct("v", "votes"), F.struct(
        (-F.col("votes")).alias("a"), F.col("first_seen").alias("b"))).alias("m"))
    keys = readings.select(*key).distinct()
    return keys.join(best, list(key), "left").select(*key, F.col("m.v").alias("value"),
                                                     F.col("m.votes").alias("votes"))


def anchor_resolve(anchors: DataFrame, rels: DataFrame, media: DataFrame,
                   min_w: int = 800, min_h: int = 400) -> DataFrame:
    """Anchors (file, anchor_row, rel_id) joined to relations (file,
    rel_id, target) and media (file, target, width, height); keep images of at
    least ``min_w`` x ``min_h``; ordered by anchor row (``seq``)."""
    j = (anchors.join(rels, ["file", "rel_id"]).join(media, ["file", "target"])
         .where((F.col("width") >= min_w) & (F.col("height") >= min_h)))
    w = Window.partitionBy("file").orderBy("anchor_row", "rel_id")
    return j.select("file", "anchor_row", "rel_id", "target", F.row_number().over(w).alias("seq"))
