"""Registered report-sheet and day-card queries (A10, B1, B3, B4, B13, B16-B18, B20, L3) over cell tables.

The test tables hold no sheets, so the runs are written as sheets, by the same SQL in both engines: report
sheets with two entities each (a leader row, a cell with age and sex, a header row, the entity's runs) and
day cards with the contests of a day at a venue. Every rule has cells that keep it and cells that break
it. The oracles parse the cells with string functions and windows over whole files.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import score as SC
from ..operators.split import cutoff_value, quantile_cutoff
from ..sources.tables import HISTORY_SQL, history
from .feature_plans import features_sql, rounded
from .registry import register
from .score_plans import _z_sql

WIDTH = 35
M = SC.DEMO_SCORER
_VENUES = sorted(G.VENUE_ABBR)


def _cells(engine: str, cells: dict[int, str]) -> str:
    """A row of WIDTH text cells, those in ``cells`` by expressions."""
    items = ", ".join(f"CAST({cells[i]} AS {'STRING' if engine == 'spark' else 'VARCHAR'})" if i in cells else "''" for i in range(WIDTH))
    return f"array({items})" if engine == "spark" else f"[{items}]"


def _say(engine: str, text: str) -> str:
    """SQL of this module in an engine's words: DIV(a, b), DAY(format, date), ITEM(list, i)."""
    if engine == "spark":
        return (text.replace("//", "div").replace("VARCHAR", "STRING").replace("strftime(event_date, '%d/%m/%y')", "date_format(event_date, 'dd/MM/yy')")
                .replace("strftime(event_date, '%d/%m/%Y')", "date_format(event_date, 'dd/MM/yyyy')").replace("strftime(event_date, '%Y%m%d')", "date_format(event_date, 'yyyyMMdd')"))
    return text


_VENUE_TEXT = "CASE " + " ".join(f"WHEN rider_id % {len(_VENUES) + 1} = {i} THEN '{v}'" for i, v in enumerate(_VENUES)) + " ELSE 'XYZ' END"
_FILE = "'Reporte_RT' || CAST(entity_id // 2 AS VARCHAR) || '_20010315.xls'"
_BASE = "(entity_id % 2) * 4000000000000000000"


def report_sql(engine: str, runs: str) -> str:
    """(file, row, cells) of the report sheets of a table of runs."""
    leader = {1: "1 + entity_id % 30", 4: "CASE WHEN entity_id % 19 = 0 THEN ' ' ELSE ' horse  ' || CAST(entity_id AS VARCHAR) END",
              30: "38 + entity_id % 35"}
    age = "CAST(2 + entity_id % 9 AS VARCHAR)"
    said = f"CASE entity_id % 5 WHEN 0 THEN {age} || ' a.' WHEN 1 THEN {age} || ' A' WHEN 2 THEN {age} || 'a' WHEN 3 THEN 'x' ELSE '  ' || {age} || '  a. ' END"
    sex = "CASE entity_id % 3 WHEN 0 THEN ' m. ' WHEN 1 THEN 'H' ELSE '?' END"
    at = lambda c: f"CASE WHEN entity_id % 6 // 2 = {c} THEN {said} WHEN entity_id % 6 // 2 - 1 - entity_id % 2 = {c} THEN {sex} ELSE '' END"
    run = {1: "CASE contest_id % 13 WHEN 0 THEN '31/02/99' WHEN 1 THEN '' WHEN 2 THEN ' ' || strftime(event_date, '%d/%m/%Y') "
              "ELSE strftime(event_date, '%d/%m/%y') END",
           4: _VENUE_TEXT, 6: "coalesce(' ' || CAST(finish_pos AS VARCHAR), 'DQ')", 7: "' winner ' || CAST(contest_id AS VARCHAR) || ' '",
           18: "CASE WHEN contest_id % 4 = 0 THEN '-' ELSE replace(CAST(load_kg AS VARCHAR), '.', ',') END", 22: "distance_m",
           25: "CASE WHEN contest_id % 3 = 0 THEN '1''' || CAST(10 + contest_id % 50 AS VARCHAR) ELSE 'x' END",
           28: "CASE WHEN contest_id % 2 = 0 THEN '-' ELSE CAST(contest_id % 90 AS VARCHAR) || ',5' END",
           30: "' rider   ' || CAST(rider_id AS VARCHAR)", 33: "400 + entity_id % 100"}
    return _say(engine, f"""
SELECT {_FILE} AS file, {_BASE} AS row, {_cells(engine, leader)} AS cells FROM (SELECT DISTINCT entity_id FROM {runs}) e
UNION ALL SELECT {_FILE}, {_BASE} + 1 + entity_id % 14, {_cells(engine, {8 + c: at(c - 2) for c in range(5)})} FROM (SELECT DISTINCT entity_id FROM {runs}) e
UNION ALL SELECT {_FILE}, {_BASE} + 20, {_cells(engine, {1: "CASE WHEN entity_id % 11 = 0 THEN 'Datum' ELSE ' Fecha ' END"})}
FROM (SELECT DISTINCT entity_id FROM {runs}) e
UNION ALL SELECT {_FILE}, {_BASE} + 100 + contest_id * 20000000 + CAST(round(px * 100) AS BIGINT), {_cells(engine, run)} FROM {runs}""")


def report_cells(spark, sf_dir):
    return spark.sql(report_sql("spark", "{runs}"), runs=history(spark, sf_dir))


_REPORT = f"""
WITH runs AS ({HISTORY_SQL}),
cells AS ({report_sql("duck", "runs")}),
led AS (SELECT *, coalesce(trim(cells[5]) <> '' AND CAST(TRY_CAST(cells[2] AS DOUBLE) AS INTEGER) BETWEEN 1 AND 25
                           AND TRY_CAST(cells[31] AS DOUBLE) BETWEEN 40 AND 70, false) AS leads FROM cells),
blk AS (SELECT *, max(CASE WHEN leads THEN row END) OVER w AS block_row, count(*) FILTER (WHERE leads) OVER w AS block_no
        FROM led WINDOW w AS (PARTITION BY file ORDER BY row)),
hdr AS (SELECT file, block_row, block_no, min(row) FILTER (WHERE lower(trim(cells[2])) = 'fecha') AS header_row,
               max(trim(cells[5])) FILTER (WHERE row = block_row) AS name,
               max(CAST(TRY_CAST(cells[2] AS DOUBLE) AS INTEGER)) FILTER (WHERE row = block_row) AS post_position
        FROM blk WHERE block_row IS NOT NULL GROUP BY file, block_row, block_no HAVING header_row IS NOT NULL),
near AS (SELECT file, block_row, row, c, cells[c + 1] AS a, cells[c] AS s1, cells[c - 1] AS s2
         FROM blk, (VALUES (10), (11), (12)) v(c) WHERE row > block_row AND row < block_row + 12),
meta AS (SELECT file, block_row, arg_min(CAST(regexp_extract(a, '^\\s*(\\d{{1,2}})\\s*a\\.?\\s*$', 1) AS INTEGER), (row, c)) AS horse_age,
                arg_min(upper(coalesce(nullif(regexp_extract(s1, '^\\s*([mMhH])\\.?\\s*$', 1), ''),
                                       regexp_extract(s2, '^\\s*([mMhH])\\.?\\s*$', 1))), (row, c)) AS sex_code
         FROM near WHERE regexp_matches(a, '^\\s*(\\d{{1,2}})\\s*a\\.?\\s*$') GROUP BY file, block_row),
dates AS (SELECT b.*, h.name, CASE length(trim(cells[2])) WHEN 8 THEN TRY_STRPTIME(trim(cells[2]), '%d/%m/%y')
                                   WHEN 10 THEN TRY_STRPTIME(trim(cells[2]), '%d/%m/%Y') END AS d
          FROM blk b JOIN hdr h ON b.file = h.file AND b.block_row = h.block_row WHERE b.row > h.header_row)
"""


@register("leader_rows", _REPORT + "SELECT file, count(*) FILTER (WHERE leads) AS n_leaders, count(*) AS n_rows FROM led GROUP BY file")
def _leader_rows(spark, sf_dir):
    return report_cells(spark, sf_dir).groupBy("file").agg(F.count_if(G.is_leader()).alias("n_leaders"), F.count(F.lit(1)).alias("n_rows"))


@register("block_header", _REPORT + "SELECT file, block_row, block_no, header_row, name, post_position FROM hdr")
def _block_header(spark, sf_dir):
    return G.block_headers(G.blocks(report_cells(spark, sf_dir))).select(
        "file", "block_row", "block_no", "header_row", "name", "post_position")


@register("block_scan_meta", _REPORT + "SELECT file, block_row, horse_age, nullif(sex_code, '') AS sex_code FROM meta")
def _block_scan_meta(spark, sf_dir):
    return G.block_meta(G.blocks(report_cells(spark, sf_dir)))


_VENUE_VALUES = ", ".join(f"('{k}', {v})" for k, v in sorted(G.VENUE_ABBR.items()))


@register("leader_broadcast", _REPORT + f"""
SELECT dt.file AS source_file, dt.row AS source_row, upper(regexp_replace(trim(dt.name), '\\s+', ' ', 'g')) AS entity_id,
       CAST(d AS DATE) AS event_date, v.venue_id, TRY_CAST(trim(cells[7]) AS INTEGER) AS finish_pos,
       CAST(TRY_CAST(trim(cells[7]) AS INTEGER) BETWEEN 1 AND 3 AS INTEGER) AS label, trim(cells[8]) AS winner_name,
       TRY_CAST(replace(cells[19], ',', '.') AS DOUBLE) AS load_kg, CAST(cells[23] AS BIGINT) AS distance_m,
       CASE WHEN cells[26] <> 'x' THEN 60.0 + CAST(substr(cells[26], 3) AS DOUBLE) END AS total_time_s,
       TRY_CAST(replace(cells[29], ',', '.') AS DOUBLE) AS dividend, upper(regexp_replace(trim(cells[31]), '\\s+', ' ', 'g')) AS rider_id,
       CAST(cells[34] AS DOUBLE) AS body_weight_kg, nullif(m.sex_code, '') AS sex_code,
       CASE WHEN m.horse_age IS NOT NULL THEN greatest(2, m.horse_age - greatest(0, 2001 - year(d))) END AS horse_age
FROM dates dt LEFT JOIN meta m ON dt.file = m.file AND dt.block_row = m.block_row
     LEFT JOIN (VALUES {_VENUE_VALUES}) v(abbr, venue_id) ON trim(cells[5]) = v.abbr
WHERE d IS NOT NULL""")
def _leader_broadcast(spark, sf_dir):
    """B13, and B5-B12 within ``parse_grid``: every run of a block with what its leader says."""
    rows, _, _ = G.parse_grid(report_cells(spark, sf_dir))
    return rounded(rows.select("source_file", "source_row", "entity_id", "event_date", "venue_id", "finish_pos", "label", "winner_name",
                               "load_kg", "distance_m", "total_time_s", "dividend", "rider_id", "body_weight_kg", "sex_code", "horse_age"))


@register("parse_audit", _REPORT + """
, f AS (SELECT DISTINCT file FROM cells), h AS (SELECT file, count(*) AS n FROM hdr GROUP BY file),
d AS (SELECT file, count(d) AS n_history, count(*) - count(d) AS n_skipped FROM dates GROUP BY file)
SELECT f.file, coalesce(h.n, 0) AS n_blocks, coalesce(d.n_history, 0) AS n_history, coalesce(d.n_skipped, 0) AS n_skipped
FROM f LEFT JOIN h ON f.file = h.file LEFT JOIN d ON f.file = d.file""")
def _parse_audit(spark, sf_dir):
    _, _, metrics = G.parse_grid(report_cells(spark, sf_dir))
    return metrics.select("file", "n_blocks", "n_history", "n_skipped")


# ------------------------------------------------------------------ day cards
_CARD = "'Programa_RT' || CAST(venue_id AS VARCHAR) || '_' || strftime(event_date, '%Y%m%d') || '.xls'"
_TIME = "CASE WHEN contest_id % 5 = 1 THEN 'soon' ELSE CAST(10 + contest_id % 12 AS VARCHAR) || ':' || CAST(10 + contest_id % 50 AS VARCHAR) END"


def card_sql(engine: str, entries: str) -> str:
    """(file, row, cells) of the day cards of a table of entries: a contest's header, its time up to six rows above, its entries."""
    head = {7: "CASE WHEN contest_id % 2 = 0 THEN 'PREMIO: X' ELSE ' premio: y' END", 25: f"CASE WHEN contest_id % 7 = 0 THEN {_TIME} ELSE '' END"}
    entry = {0: "CASE WHEN entity_id % 10 = 0 THEN 'x' ELSE CAST(n AS VARCHAR) || 'a' END", 2: "'horse  ' || CAST(entity_id AS VARCHAR)",
             11: "load_kg", 14: "CASE entity_id % 3 WHEN 0 THEN 'm.' WHEN 1 THEN ' Hembra' ELSE '' END", 15: "2 + entity_id % 9",
             16: "CASE WHEN rider_id % 8 = 0 THEN ' ' ELSE ' rider ' || CAST(rider_id AS VARCHAR) END"}
    contests = f"(SELECT DISTINCT contest_id, venue_id, event_date FROM {entries} WHERE venue_id IS NOT NULL) c"
    return _say(engine, f"""
SELECT {_CARD} AS file, contest_id * 100 + 50 AS row, {_cells(engine, head)} AS cells FROM {contests}
UNION ALL SELECT {_CARD}, contest_id * 100 + 50 - contest_id % 7, {_cells(engine, {25: _TIME})} FROM {contests} WHERE contest_id % 7 > 0
UNION ALL SELECT {_CARD}, contest_id * 100 + 50 + n, {_cells(engine, entry)}
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY px) AS n FROM {entries} WHERE venue_id IS NOT NULL) e""")


def reading_sql(engine: str, entries: str) -> str:
    """(file, seq, text): three readings of each contest's distance, one of them wrong; every ninth contest has none."""
    contests = f"""(SELECT *, row_number() OVER (PARTITION BY venue_id, event_date ORDER BY contest_id) AS seq
        FROM (SELECT DISTINCT contest_id, venue_id, event_date, distance_m FROM {entries} WHERE venue_id IS NOT NULL) d) c"""
    said = [f"CAST(distance_m AS VARCHAR) || '{end}'" for end in (" mts", "mt.")] + ["'(900 MTS)'"]
    return _say(engine, " UNION ALL ".join(
        f"SELECT {_CARD} AS file, seq, CASE WHEN contest_id % 9 = 0 THEN 'no reading' ELSE {x} END AS text FROM {contests}" for x in said))


_CARDS = f"""
WITH runs AS ({HISTORY_SQL}),
k AS (SELECT *, {_CARD} AS file FROM (SELECT DISTINCT contest_id, venue_id, event_date, distance_m FROM runs WHERE venue_id IS NOT NULL) c),
contests AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY contest_id) AS contest_no, contest_id * 100 + 50 AS header_row,
                    CASE WHEN contest_id % 7 < 6 AND contest_id % 5 <> 1 THEN {_TIME} END AS start_time FROM k)
"""


def _entries(spark, sf_dir):
    return history(spark, sf_dir)


def card_cells(spark, entries):
    return spark.sql(card_sql("spark", "{entries}"), entries=entries)


def card_readings(spark, entries):
    return spark.sql(reading_sql("spark", "{entries}"), entries=entries)


@register("lookback_scan", _CARDS + "SELECT file, contest_no, header_row, start_time FROM contests")
def _lookback_scan(spark, sf_dir):
    c = G.card_contests(card_cells(spark, history(spark, sf_dir)))
    return c.where(F.col("row") == F.col("header_row")).select("file", "contest_no", "header_row", "start_time")


@register("entry_rows", _CARDS + """
, e AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY px) AS n FROM runs WHERE venue_id IS NOT NULL)
SELECT c.file, c.contest_no, c.header_row + e.n AS row, CAST(e.n AS INTEGER) AS post_position, 'horse  ' || CAST(e.entity_id AS VARCHAR) AS entity_name,
       e.load_kg AS kg, CASE e.entity_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'H' END AS sex_code, CAST(2 + e.entity_id % 9 AS INTEGER) AS horse_age,
       CASE WHEN e.rider_id % 8 <> 0 THEN 'rider ' || CAST(e.rider_id AS VARCHAR) END AS rider_name
FROM e JOIN contests c ON e.contest_id = c.contest_id WHERE e.entity_id % 10 <> 0 AND e.load_kg BETWEEN 40 AND 70""")
def _entry_rows(spark, sf_dir):
    return G.entry_rows(G.card_contests(card_cells(spark, history(spark, sf_dir))))


@register("ordinal_zip", _CARDS + "SELECT file, contest_no, CASE WHEN contest_id % 9 = 0 THEN 0 ELSE distance_m END AS distance_m FROM contests")
def _ordinal_zip(spark, sf_dir):
    h = history(spark, sf_dir)
    votes = G.modal_vote(card_readings(spark, h), ["file", "seq"], "seq", "text").select("file", "seq", F.col("value").alias("distance_m"))
    return G.ordinal_zip(G.card_contests(card_cells(spark, h)), votes)


@register("anchor_resolve", f"""
WITH runs AS ({HISTORY_SQL}),
a AS (SELECT DISTINCT contest_id % 500 AS file, entity_id AS anchor_row, 'r' || CAST(rider_id AS VARCHAR) AS rel_id, rider_id FROM runs)
SELECT file, anchor_row, rel_id, 'image' || CAST(rider_id % 50 AS VARCHAR) AS target,
       row_number() OVER (PARTITION BY file ORDER BY anchor_row, rel_id) AS seq
FROM a WHERE rider_id % 4 <> 0 AND 600 + (rider_id % 50 % 7) * 100 >= 800 AND 300 + (rider_id % 50 % 4) * 100 >= 400""")
def _anchor_resolve(spark, sf_dir):
    """Pictures on sheets: every fourth rider's has no relation, some are too small."""
    h = history(spark, sf_dir).select((F.col("contest_id") % 500).alias("file"), "entity_id", "rider_id")
    rel, target = F.concat(F.lit("r"), F.col("rider_id").cast("string")), F.concat(F.lit("image"), (F.col("rider_id") % 50).cast("string"))
    anchors = h.select("file", F.col("entity_id").alias("anchor_row"), rel.alias("rel_id")).distinct()
    rels = h.where(F.col("rider_id") % 4 != 0).select("file", rel.alias("rel_id"), target.alias("target")).distinct()
    media = h.select("file", target.alias("target"), (600 + F.col("rider_id") % 50 % 7 * 100).alias("width"),
                     (300 + F.col("rider_id") % 50 % 4 * 100).alias("height")).distinct()
    return G.anchor_resolve(anchors, rels, media).withColumn("seq", F.col("seq").cast("long"))


@register("score_day_card", f"""
WITH v AS ({features_sql('card', rnd=False)}),
s AS (SELECT v.*, 1.0 / (1.0 + exp(-{_z_sql()})) AS p FROM v),
k AS (SELECT DISTINCT contest_id, racetrack_id AS venue_id, event_date FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY venue_id, event_date ORDER BY contest_id) AS contest_no,
             count(*) OVER (PARTITION BY venue_id, event_date) AS n_contests FROM k),
r AS (SELECT o.*, s.px, s.entity_id, s.p, row_number() OVER (PARTITION BY s.contest_id ORDER BY s.px) AS n,
             s.distance_m FROM s JOIN o ON s.contest_id = o.contest_id),
e AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, px) AS rank FROM r)
SELECT 'Programa_RT' || CAST(venue_id AS VARCHAR) || '_' || strftime(event_date, '%Y%m%d') || '.xls' AS file, 'ok' AS status, contest_no, n_contests,
       CASE WHEN contest_id % 7 < 6 AND contest_id % 5 <> 1 THEN {_TIME} END AS start_time,
       CASE WHEN contest_id % 9 = 0 THEN 0 ELSE distance_m END AS distance_source_m, distance_m AS distance_used_m,
       '{M.name}' AS model_name, '{M.version}' AS model_version, CAST(n AS INTEGER) AS post_position, 'HORSE ' || CAST(entity_id AS VARCHAR) AS entity_id,
       round(p, 6) AS p, rank FROM e
UNION ALL SELECT 'Programa_RT99_19990101.xls', 'not_found', NULL, NULL, NULL, NULL, NULL, '{M.name}', '{M.version}', NULL, NULL, NULL, NULL""")
def _score_day_card(spark, sf_dir):
    """The cards of all contests to be scored, from cells to nested records, and a card that is not there; records flattened again."""
    allr = history(spark, sf_dir)
    lab = allr.where(F.col("finish_pos").isNotNull())
    c = cutoff_value(quantile_cutoff(lab, 0.2))
    name = lambda word, col: F.concat(F.lit(f"{word} "), F.col(col).cast("string"))
    past = lab.where(F.col("event_date") < c).withColumns({"entity_id": name("Horse", "entity_id"), "rider_id": name("Rider", "rider_id")})
    # on a card each entry is readable: what cannot be read is in entry_rows
    entries = allr.where(F.col("finish_pos").isNull() & (F.col("event_date") >= c) & (F.col("entity_id") % 10 != 0) & (F.col("rider_id") % 8 != 0))
    cells = card_cells(spark, entries)
    asked = cells.select("file").distinct().union(spark.createDataFrame([("Programa_RT99_19990101.xls",)], "file STRING"))
    out = SC.score_day_card(cells, card_readings(spark, entries), past, M, requested=asked)
    flat = out.select("file", "status", "contest_no", "n_contests", "start_time", "distance_source_m", "distance_used_m", "model_name",
                      "model_version", F.explode_outer("entries").alias("e"))
    return rounded(flat.select("file", "status", "contest_no", "n_contests", "start_time", "distance_source_m", "distance_used_m", "model_name",
                               "model_version", "e.post_position", "e.entity_id", "e.p", F.col("e.rank").cast("long").alias("rank")))
