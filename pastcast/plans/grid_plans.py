"""Registered grid / cell-parsing queries.

Binding (FIXTURES §6): every line of ``documents.text`` is a grid row of the
document ``file = doc_id``; cells are the line's space-separated tokens; a
block leader is a line starting with ``A``-``M``. Day-card segments use
``conversations`` (a ``user`` turn opens a segment). Readings for the modal
vote are the numbers of ``documents.text``, voted per ``source``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid as G
from ..sources.tables import HISTORY_SQL, history, table
from .feature_plans import rounded
from .registry import register

LEADER_RE = "^[A-M]"


def doc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a cell table (file, row, line, cells)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select(F.col("doc_id").cast("string").alias("file"), "doc_id", "source", "row", "line",
                        F.split("line", " ").alias("cells"))


CELLS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS file, doc_id, source, row, line, string_split(line, ' ') AS cells
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents) x
"""


@register("cells_source", f"""
WITH c AS ({CELLS_SQL})
SELECT doc_id, count(*) AS n_rows, sum(len(cells)) AS n_cells, max(len(cells)) AS max_cells
FROM c GROUP BY doc_id
""")
def _cells_source(spark, sf_dir):
    c = doc_cells(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum(F.size("cells")).alias("n_cells"),
                                   F.max(F.size("cells")).alias("max_cells"))


BLOCK_SQL = f"""
WITH c AS ({CELLS_SQL}),
s AS (SELECT *, CASE WHEN regexp_matches(line, '{LEADER_RE}') THEN row END AS st FROM c),
b AS (SELECT *, max(st) OVER (PARTITION BY file ORDER BY row) AS block_row,
             count(st) OVER (PARTITION BY file ORDER BY row) AS block_no FROM s)
"""


@register("block_segment", BLOCK_SQL + """
SELECT doc_id, block_no, block_row, count(*) AS n_rows, sum(len(cells)) AS n_cells
FROM b WHERE block_row IS NOT NULL GROUP BY doc_id, block_no, block_row
""")
def _block_segment(spark, sf_dir):
    c = doc_cells(spark, sf_dir)
    b = G.blocks(c, F.col("line").rlike(LEADER_RE))
    return b.groupBy("doc_id", "block_no", "block_row").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))


TOKENS_SQL = f"""
WITH c AS ({CELLS_SQL}), t AS (SELECT doc_id, unnest(cells) AS tok FROM c)
"""


def doc_tokens(spark, sf_dir):
    return doc_cells(spark, sf_dir).select("doc_id", F.explode("cells").alias("tok"))


# Cells as a sheet has them, written from the runs in both engines: each form on the hit and on the miss path.
@register("history_row_filter", f"""
WITH r AS ({HISTORY_SQL}),
t AS (SELECT contest_id % 100 AS part, contest_id % 5 AS kind, event_date FROM r)
SELECT part, count(*) FILTER (WHERE kind < 4) AS n_date_like, count(*) FILTER (WHERE kind < 3) AS n_valid_dates,
       sum(CASE WHEN kind < 3 THEN datediff('day', DATE '1970-01-01', event_date) END)::BIGINT AS day_sum
FROM t GROUP BY part
""")
def _history_row_filter(spark, sf_dir):
    kind, d = F.col("contest_id") % 5, F.col("event_date")
    tok = (F.when(kind == 0, F.date_format(d, "dd/MM/yy")).when(kind == 1, F.date_format(d, " dd/MM/yyyy\t"))
           .when(kind == 2, F.concat(F.lit(" "), F.date_format(d, "dd/MM/yy"))).when(kind == 3, F.lit("31/02/99"))
           .otherwise(F.date_format(d, "d-M-yy")))
    t = history(spark, sf_dir).select((F.col("contest_id") % 100).alias("part"), tok.alias("tok"))
    like, day = S.trimmed("tok").rlike(r"^(\d{2})/(\d{2})/(\d{2,4})$"), S.parse_ddmmyy("tok")
    return t.groupBy("part").agg(F.count_if(like).alias("n_date_like"), F.count_if(day.isNotNull()).alias("n_valid_dates"),
                                 F.sum(F.unix_date(day)).cast("long").alias("day_sum"))


@register("parse_position", f"""
WITH r AS ({HISTORY_SQL})
SELECT contest_id % 100 AS part, count(finish_pos) AS n_positions, coalesce(sum(finish_pos), 0)::BIGINT AS pos_sum
FROM r GROUP BY 1
""")
def _parse_position(spark, sf_dir):
    # a run without a position has a word, too long a number or nothing in its cell
    miss = F.element_at(F.array(*[F.lit(x) for x in ("DQ", "105", "", "-")]), (F.col("contest_id") % 4 + 1).cast("int"))
    tok = F.coalesce(F.concat(F.lit(" "), F.col("finish_pos").cast("string"), F.lit("\t")), miss)
    p = F.regexp_extract("tok", G.POS_PATTERN, 1).try_cast("int")
    return (history(spark, sf_dir).select((F.col("contest_id") % 100).alias("part"), tok.alias("tok")).groupBy("part")
            .agg(F.count(p).alias("n_positions"), F.coalesce(F.sum(p), F.lit(0)).cast("long").alias("pos_sum")))


@register("numeric_cell", TOKENS_SQL + r"""
, n AS (SELECT doc_id, trim(replace(tok, ',', '.')) AS s FROM t)
SELECT doc_id, count(*) AS n_numbers,
       round(sum(TRY_CAST(regexp_extract(s, '([-+]?\d*\.?\d+)', 1) AS DOUBLE)), 6) AS num_sum,
       sum(TRY_CAST(trunc(TRY_CAST(regexp_extract(s, '([-+]?\d*\.?\d+)', 1) AS DOUBLE)) AS BIGINT)) AS int_sum
FROM n WHERE s NOT IN ('', '-', '—') AND regexp_extract(s, '([-+]?\d*\.?\d+)', 1) <> ''
GROUP BY doc_id
""")
def _numeric_cell(spark, sf_dir):
    t = doc_tokens(spark, sf_dir)
    v = S.numeric_cell("tok")
    return rounded(t.where(v.isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_numbers"), F.sum(v).alias("num_sum"),
        F.sum(S.int_cell("tok").cast("long")).alias("int_sum")))


@register("time_to_seconds", f"""
WITH r AS ({HISTORY_SQL}),
n AS (SELECT contest_id, px, contest_id % 7 AS kind, entity_id % 3 AS m, contest_id % 60 AS s, (entity_id % 100) / 100.0 AS c FROM r)
SELECT contest_id, px, round(CAST(CASE kind WHEN 0 THEN m * 60 + s + c WHEN 1 THEN s + c WHEN 2 THEN m * 60 + s
       WHEN 3 THEN m * 60 + s + c WHEN 4 THEN s + c WHEN 5 THEN m * 60 + s + c END AS DOUBLE), 6) AS seconds
FROM n
""")
def _time_to_seconds(spark, sf_dir):
    kind, m, s = F.col("contest_id") % 7, F.col("entity_id") % 3, F.col("contest_id") % 60
    c = F.lpad((F.col("entity_id") % 100).cast("string"), 2, "0")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    m, s = m.cast("string"), s.cast("string")
    tok = (F.when(kind == 0, text(m, "'", s, "''", c)).when(kind == 1, text(s, "''", c)).when(kind == 2, text(m, "'", s))
           .when(kind == 3, text(m, "'", s, ".", c)).when(kind == 4, text("\t", s, ".", c, " "))
           .when(kind == 5, text(" ", m, "'", s, "''", c, " ")).otherwise(text(m, "h", s)))
    return rounded(history(spark, sf_dir).select("contest_id", "px", S.time_to_seconds(tok).alias("seconds")))


@register("norm_name", f"""
WITH c AS ({CELLS_SQL})
SELECT doc_id, row, md5(replace(upper(trim(regexp_replace(line, '\\s+', ' ', 'g'))), 'ẞ', 'SS')) AS name_md5
FROM c WHERE regexp_matches(line, '{LEADER_RE}')
""")
def _norm_name(spark, sf_dir):
    c = doc_cells(spark, sf_dir).where(F.col("line").rlike(LEADER_RE))
    return c.select("doc_id", "row", F.md5(S.norm_name("line")).alias("name_md5"))


# --- fixed values: the venue abbreviations, as a SQL VALUES list -------------
_VENUE_VALUES = ", ".join(f"('{k}', {v})" for k, v in sorted(G.VENUE_ABBR.items()))
# --- end of fixed values -----------------------------------------------------


_VENUES = sorted(G.VENUE_ABBR)
_ABBR_SQL = "[" + ", ".join(f"'{v}'" for v in _VENUES) + ", 'NOWHERE', '']"


@register("venue_lookup", f"""
WITH r AS ({HISTORY_SQL}), dim AS (SELECT * FROM (VALUES {_VENUE_VALUES}) v(venue_abbr, venue_id)),
t AS (SELECT contest_id % 100 AS part, ({_ABBR_SQL})[CAST(entity_id % {len(_VENUES) + 2} AS INTEGER) + 1] AS tok FROM r)
SELECT part, count(*) AS n_tokens, count(dim.venue_id) AS n_known, coalesce(sum(dim.venue_id), 0)::BIGINT AS id_sum
FROM t LEFT JOIN dim ON t.tok = dim.venue_abbr GROUP BY part
""")
def _venue_lookup(spark, sf_dir):
    abbr = F.element_at(F.array(*[F.lit(f" {v.lower()}\t") for v in [*_VENUES, "NOWHERE", ""]]),
                        (F.col("entity_id") % (len(_VENUES) + 2) + 1).cast("int"))
    t = history(spark, sf_dir).select((F.col("contest_id") % 100).alias("part"), F.upper(S.trimmed(abbr)).alias("venue_abbr"))
    j = t.join(F.broadcast(G.venue_dim(spark)), "venue_abbr", "left")  # fixed 14-row dimension
    return j.groupBy("part").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("venue_id").alias("n_known"),
                                 F.coalesce(F.sum("venue_id"), F.lit(0)).cast("long").alias("id_sum"))


@register("label_derive", f"""
WITH r AS ({HISTORY_SQL})
SELECT CAST(finish_pos BETWEEN 1 AND 3 AS INTEGER) AS label, count(*) AS n FROM r GROUP BY 1
""")
def _label_derive(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.groupBy(S.label_from_position("finish_pos").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("age_at_event", f"""
WITH r AS ({HISTORY_SQL})
SELECT contest_id, px,
       CAST(greatest(2, (2 + entity_id % 9) - greatest(0, 2001 - year(event_date))) AS INTEGER) AS age
FROM r
""")
def _age_at_event(spark, sf_dir):
    h = history(spark, sf_dir)
    # binding: document age 2 + entity % 9, document year 2001
    return h.select("contest_id", "px", S.age_at_event((F.lit(2) + F.col("entity_id") % 9).cast("int"),
                                                      F.lit(2001), F.year("event_date")).alias("age"))


@register("dedup_keep_first", f"""
WITH r AS ({HISTORY_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, event_date, venue_id, distance_m
                                   ORDER BY contest_id, px) AS rn FROM r)
SELECT entity_id, event_date, venue_id, distance_m, contest_id, px, finish_pos, load_kg FROM k WHERE rn = 1
""")
def _dedup_keep_first(spark, sf_dir):
    h = history(spark, sf_dir).select("entity_id", "event_date", "venue_id", "distance_m", "contest_id",
                                      "px", "finish_pos", "load_kg")
    return G.dedup_keep_first(h, ["entity_id", "event_date", "venue_id", "distance_m"], ["contest_id", "px"])


@register("contest_segment", """
WITH c AS (SELECT conv_id, turn, role,
                  count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS contest_no,
                  max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS header_turn
           FROM conversations)
SELECT conv_id, contest_no, header_turn, count(*) - 1 AS n_entries
FROM c WHERE header_turn IS NOT NULL GROUP BY conv_id, contest_no, header_turn
""")
def _contest_segment(spark, sf_dir):
    cv = table(spark, sf_dir, "conversations")
    seg = G.segment(cv, ["conv_id"], "turn", F.col("role") == "user")
    return (seg.where(F.col("seg_start").isNotNull())
            .groupBy("conv_id", F.col("seg_no").alias("contest_no"), F.col("seg_start").alias("header_turn"))
            .agg((F.count(F.lit(1)) - 1).alias("n_entries")))


@register("modal_vote", """
WITH r AS (SELECT source, doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS k
           FROM (SELECT source, doc_id, regexp_extract_all(text, '(\\d{3,4})', 1) AS l FROM documents) x),
c AS (SELECT source, doc_id, k, TRY_CAST(tok AS INTEGER) AS v FROM r),
v AS (SELECT source, v, count(*) AS votes, min(doc_id * 1000000 + k) AS first_seen
      FROM c WHERE v BETWEEN 800 AND 3000 GROUP BY source, v),
b AS (SELECT source, arg_min(v, (-votes, first_seen)) AS value, max(votes) AS votes FROM v GROUP BY source)
SELECT s.source, b.value, b.votes FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN b ON s.source = b.source
""")
def _modal_vote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return G.modal_vote(d, ["source"], "doc_id", "text", pattern=r"(\d{3,4})")
