"""Registered source / sink, calendar, run-log, scalar-function and set
queries (A1-A15, E27, K13, H1, H2, I1-I10)."""
from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as MT
from ..operators import score as SC
from ..operators import selection as SEL
from ..schema import HISTORY_SCHEMA
from ..session import ensure_checkpoint_dir
from ..sources import calendar as CAL
from ..sources import files as FS
from ..sources.runlog import RunLog
from ..sources.tables import HISTORY_SQL, history, table
from .eval_plans import LAB_SQL
from .feature_plans import eval_features, features_sql, rounded
from .registry import register


def _scratch(spark, name: str, sf_dir: str) -> str:
    """Tables this catalogue materialises live under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    path = sf_dir.rstrip("/")
    tag = f"{os.path.basename(path)}_{hashlib.md5(path.encode()).hexdigest()[:12]}"  # two folders may share a name
    return os.path.join(base, f"{name}_{tag}")


# ------------------------------------------------------------ A1 / A2
_YEAR_SQL = f"""
WITH r AS ({HISTORY_SQL})
SELECT year(event_date) AS event_year, count(*) AS n_rows, count(finish_pos) AS n_labelled,
       round(sum(load_kg), 6) AS kg_sum FROM r GROUP BY 1
"""


def _written_history(spark, sf_dir, name):
    cols = [f.name for f in HISTORY_SCHEMA.fields]
    return FS.write_history(history(spark, sf_dir).select(*cols), _scratch(spark, name, sf_dir), use_cache=False)


@register("write_history", _YEAR_SQL)
def _write_history(spark, sf_dir):
    h = _written_history(spark, sf_dir, "history")
    return rounded(h.groupBy("event_year").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.count("finish_pos").alias("n_labelled"),
                                               F.sum("load_kg").alias("kg_sum")))


@register("scan_history", _YEAR_SQL)
def _scan_history(spark, sf_dir):
    _written_history(spark, sf_dir, "scanned")
    schema = T.StructType(HISTORY_SCHEMA.fields + [T.StructField("event_year", T.IntegerType())])
    h = FS.scan_history(spark, _scratch(spark, "scanned", sf_dir), schema)
    return rounded(h.groupBy("event_year").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.count("finish_pos").alias("n_labelled"),
                                               F.sum("load_kg").alias("kg_sum")))


# ------------------------------------------------------------ A3 / A4 (no oracle: file system)
@register("list_documents")
def _list_documents(spark, sf_dir):
    return FS.list_documents(spark, sf_dir, "*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@register("signature_quarantine")
def _signature(spark, sf_dir):
    files = FS.document_heads(spark, sf_dir, max(len(FS.PARQUET_MAGIC), len(FS.WORKBOOK_MAGIC)) // 2, "*.parquet")
    good, bad = FS.signature_quarantine(files, FS.PARQUET_MAGIC)
    wb_good, wb_bad = FS.signature_quarantine(files, FS.WORKBOOK_MAGIC)
    return (good.select(F.lit("parquet").alias("check"), F.lit("accepted").alias("outcome"), "path")
            .unionByName(bad.select(F.lit("parquet").alias("check"), F.lit("rejected").alias("outcome"), "path"))
            .unionByName(wb_good.select(F.lit("workbook").alias("check"), F.lit("accepted").alias("outcome"), "path"))
            .unionByName(wb_bad.select(F.lit("workbook").alias("check"), F.lit("rejected").alias("outcome"), "path"))
            .groupBy("check", "outcome").agg(F.count(F.lit(1)).alias("n_files")))


# ------------------------------------------------------------ A5 - A9
@register("landing_plan", """
WITH w AS (SELECT DISTINCT CAST(ts AS DATE) AS d, CAST(user_id % 50 AS INTEGER) AS venue_id FROM events)
SELECT d, venue_id FROM w WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.event_type = 'error' AND CAST(e.ts AS DATE) = w.d AND e.user_id % 50 = w.venue_id)
""")
def _landing_plan(spark, sf_dir):
    # a document is wanted for every day and venue with events; it has landed where one is an error
    ev = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("d"), (F.col("user_id") % 50).cast("int").alias("venue_id"))
    return FS.landing_plan(ev.select("d", "venue_id").distinct(), ev.where(F.col("event_type") == "error"), ["d", "venue_id"])


# day records built from events: a BOM on click rows, malformed dates on error rows
def _rec_spark():
    return F.concat(
    F.when(F.col("event_type") == "click", F.lit("\ufeff")).otherwise(F.lit("")),
    F.lit('{"date": "'),
    F.when(F.col("event_type") == "error", F.lit("2024-02-30")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
    F.lit('", "has_program": '),
    F.when(F.get_json_object("props", "$.k").try_cast("int") > 50, F.lit("true")).otherwise(F.lit("false")),
    F.lit(', "venue_id": '), (F.col("user_id") % 5).cast("string"), F.lit("}"))


_DAYS_SQL = """
SELECT CAST(user_id % 5 AS INTEGER) AS venue_id, CAST(ts AS DATE) AS date,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50, false) AS has_program
FROM events WHERE event_type <> 'error'
"""


def _days(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return CAL.parse_day_records(ev.select(_rec_spark().alias("value")))


@register("calendar_normalise", _DAYS_SQL)
def _calendar_normalise(spark, sf_dir):
    return _days(spark, sf_dir)


@register("calendar_window", f"""
SELECT * FROM ({_DAYS_SQL}) d
WHERE date BETWEEN DATE '2024-01-15' - 3 AND DATE '2024-01-15' + 7 AND has_program
""")
def _calendar_window(spark, sf_dir):
    return CAL.calendar_window(_days(spark, sf_dir), F.lit("2024-01-15").cast("date"), 3, 7)


@register("daily_target_grid", f"""
WITH r AS ({HISTORY_SQL}), v AS (SELECT DISTINCT venue_id FROM r WHERE venue_id IS NOT NULL)
SELECT venue_id, CAST(d AS DATE) AS date FROM v, (VALUES (DATE '2001-01-01'), (DATE '2001-01-02')) t(d)
""")
def _daily_target_grid(spark, sf_dir):
    venues = history(spark, sf_dir).where(F.col("venue_id").isNotNull()).select("venue_id").distinct()
    return CAL.daily_target_grid(venues, F.lit("2001-01-01").cast("date"), 2)


@register("document_path_fields", """
WITH n AS (SELECT 'Tabulada_RT' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '.xls' AS name,
                  user_id, CAST(ts AS DATE) AS d FROM events)
SELECT 'Tabulada' AS doc_type, count(*) AS n_docs,
       count(*) FILTER (WHERE CAST(regexp_extract(name, '_RT(\\d+)_', 1) AS BIGINT) = user_id) AS venue_ok,
       count(DISTINCT d) AS n_dates FROM n
""")
def _document_path_fields(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    n = ev.select(FS.document_name(F.lit("Tabulada"), F.col("user_id"), F.to_date("ts")).alias("name"),
                  "user_id", F.to_date("ts").alias("d"))
    p = n.select("user_id", "d", *FS.document_fields(F.col("name")))
    return p.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.count_if(F.col("venue_id") == F.col("user_id")).alias("venue_ok"),
                                     F.count_distinct("doc_date").alias("n_dates"))


# ------------------------------------------------------------ A11 / A15
@register("csv_tables", f"""
WITH r AS ({HISTORY_SQL})
SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM r GROUP BY label
""")
def _csv_tables(spark, sf_dir):
    h = history(spark, sf_dir)
    tab = h.groupBy(F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    path = _scratch(spark, "label_counts_csv", sf_dir)
    FS.write_csv(tab, path)
    return FS.read_csv(spark, path, T.StructType([T.StructField("label", T.StringType()),
                                                  T.StructField("n", T.LongType())]))


_FP_COLS = ["entity_id", "rider_id", "contest_id", "event_date", "venue_id", "distance_m", "finish_pos"]


@register("dataset_fingerprint", f"""
WITH r AS ({HISTORY_SQL}),
h AS (SELECT CAST('0x' || substr(md5(concat_ws(chr(1), {', '.join(f"coalesce(CAST({c} AS VARCHAR), '<NULL>')" for c in _FP_COLS)})), 1, 15) AS BIGINT) AS x FROM r)
SELECT count(*) AS n_rows, bit_xor(x) AS xor_hash, CAST(sum(CAST(x AS HUGEINT)) AS VARCHAR) AS sum_hash FROM h
""")
def _fingerprint(spark, sf_dir):
    h = history(spark, sf_dir)
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in _FP_COLS])
    x = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(x).alias("xor_hash"),
                 F.sum(x.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


# ------------------------------------------------------------ A12 / A13 / E27 / K13
V1 = SC.DEMO_SCORER
V2 = SC.LinearScorer(intercept=V1.intercept, coef={k: v for k, v in V1.coef.items() if k != "track_show_rate"},
                     center=V1.center, name="linear-reduced", version="2")
_RUN_KEYS = ["roc_auc", "log_loss", "brier", "positive_rate"]


def _z(m: SC.LinearScorer) -> str:
    z = f"CAST({m.intercept} AS DOUBLE)"
    for c, w in m.coef.items():
        z = f"({z} + CAST({w} AS DOUBLE) * coalesce(CAST({c} AS DOUBLE), CAST({m.center[c]} AS DOUBLE)))"
    return z


def _run_metric_sql(run: str, m: SC.LinearScorer) -> str:
    p = f"(1.0 / (1.0 + exp(-{_z(m)})))"
    return f"""
s_{run} AS (SELECT label, {p} AS p FROM f),
sc_{run} AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
             FROM s_{run} GROUP BY p),
au_{run} AS (SELECT sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM
             (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
              FROM sc_{run}) z),
m_{run} AS (SELECT '{run}' AS run_id, au_{run}.roc_auc,
              avg(-(label * ln(least(greatest(p, 1e-6), 1 - 1e-6))
                    + (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss,
              avg((p - label) * (p - label)) AS brier, avg(CAST(label AS DOUBLE)) AS positive_rate
            FROM s_{run}, au_{run} GROUP BY au_{run}.roc_auc)"""


_RUNLOG_SQL = f"""
WITH f AS ({features_sql('eval', rnd=False)}),
{_run_metric_sql('v1', V1)},
{_run_metric_sql('v2', V2)},
w AS (SELECT * FROM m_v1 UNION ALL SELECT * FROM m_v2),
log AS (SELECT run_id, 'search' AS parent_run_id, 'metric' AS kind, key, value FROM w
        UNPIVOT (value FOR key IN ({', '.join(_RUN_KEYS)})))
"""


def _params(m: SC.LinearScorer) -> dict:
    return {"intercept": m.intercept, **{f"coef.{c}": w for c, w in m.coef.items()}}


def _logged(spark, sf_dir):
    """A search and its two runs, appended to a stored log; then the job is repeated."""
    ensure_checkpoint_dir(spark)
    # features computed once for both runs: reliable checkpoint, short lineage
    f = eval_features(spark, sf_dir).checkpoint(eager=True)
    log = RunLog(spark, f"{_scratch(spark, 'run_log', sf_dir)}-{uuid.uuid4().hex[:12]}")
    for again in range(2):
        added = [log.append("search", {"runs": 2, "part": "test"})]
        added += [log.append(run, _params(m), _wide_metrics(m(f)), parent="search") for run, m in (("v1", V1), ("v2", V2))]
        if any(x == bool(again) for x in added):
            raise RuntimeError("the log did not keep each run once")
    return log.read()


def _run_log(spark, sf_dir):
    return _logged(spark, sf_dir).where("kind = 'metric'").select("run_id", "parent_run_id", "kind", "key", "value")


_PARAMS_SQL = " UNION ALL ".join(
    ["SELECT 'search' AS run_id, NULL AS parent_run_id, 'param' AS kind, 'runs' AS key, CAST(2 AS DOUBLE) AS value, '2' AS text",
     "SELECT 'search', NULL, 'param', 'part', NULL, 'test'"]
    + [f"SELECT '{run}', 'search', 'param', '{k}', CAST({v!r} AS DOUBLE), '{v}'" for run, m in (("v1", V1), ("v2", V2)) for k, v in _params(m).items()])


def _wide_metrics(s):
    s = s.withColumn("_all", F.lit(0))
    a = MT.threshold_metrics(s, "label", "p", by=["_all"])
    b = MT.roc_auc(s, "label", "p", by=["_all"])
    return a.join(b, "_all").select(*_RUN_KEYS)


@register("run_log", _RUNLOG_SQL + f"""
SELECT run_id, parent_run_id, kind, key, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM log
UNION ALL SELECT run_id, parent_run_id, kind, key, round(value, 6), text FROM ({_PARAMS_SQL}) p
""")
def _run_log_q(spark, sf_dir):
    return rounded(_logged(spark, sf_dir))


@register("best_run", _RUNLOG_SQL + """
SELECT arg_max(run_id, (value, run_id)) AS run_id, round(max(value), 6) AS roc_auc FROM log WHERE key = 'roc_auc'
""")
def _best_run(spark, sf_dir):
    return rounded(CAL.best_run(_run_log(spark, sf_dir), "roc_auc"))


_CMP_SQL = _RUNLOG_SQL + """,
cmp AS (SELECT key, max(value) FILTER (WHERE run_id = 'v1') AS base,
               max(value) FILTER (WHERE run_id = 'v2') AS candidate FROM log GROUP BY key)
"""


@register("version_compare", _CMP_SQL + """
SELECT key, round(base, 6) AS base, round(candidate, 6) AS candidate, round(candidate - base, 6) AS delta FROM cmp
""")
def _version_compare(spark, sf_dir):
    return rounded(CAL.version_compare(_run_log(spark, sf_dir), "v1", "v2", _RUN_KEYS))


@register("adopt_rule", _CMP_SQL + """
SELECT round(a.candidate - a.base, 6) AS d_roc_auc, round(l.candidate - l.base, 6) AS d_log_loss,
       (a.candidate - a.base >= -0.002 AND l.candidate - l.base <= 0.005) AS adopt
FROM cmp a, cmp l WHERE a.key = 'roc_auc' AND l.key = 'log_loss'
""")
def _adopt_rule(spark, sf_dir):
    c = CAL.version_compare(_run_log(spark, sf_dir), "v1", "v2", ["roc_auc", "log_loss"])
    w = c.groupBy().pivot("key", ["roc_auc", "log_loss"]).agg(F.first("delta"))
    w = w.select(F.col("roc_auc").alias("d_roc_auc"), F.col("log_loss").alias("d_log_loss"))
    return rounded(SEL.adopt_rule(w))


# ------------------------------------------------------------ H1 / H2
@register("union_sources", f"""
WITH r AS ({HISTORY_SQL})
SELECT src, count(*) AS n_rows, count(dividend) AS n_dividend FROM
 (SELECT 'labelled' AS src, dividend FROM r WHERE finish_pos IS NOT NULL
  UNION ALL SELECT 'unlabelled' AS src, NULL AS dividend FROM r WHERE finish_pos IS NULL) u
GROUP BY src
""")
def _union_sources(spark, sf_dir):
    h = history(spark, sf_dir)
    a = h.where(F.col("finish_pos").isNotNull()).select(F.lit("labelled").alias("src"), "dividend")
    b = h.where(F.col("finish_pos").isNull()).select(F.lit("unlabelled").alias("src"))
    u = a.unionByName(b, allowMissingColumns=True)   # H1: missing columns -> NULL
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.count("dividend").alias("n_dividend"))


@register("column_set_diff", f"""
WITH r AS ({HISTORY_SQL})
SELECT count(*) AS n_rows FROM (SELECT contest_id, px FROM r EXCEPT ALL
                                SELECT contest_id, px FROM r WHERE finish_pos IS NOT NULL) d
""")
def _column_set_diff(spark, sf_dir):
    h = history(spark, sf_dir).select("contest_id", "px", "finish_pos")
    d = h.select("contest_id", "px").exceptAll(h.where(F.col("finish_pos").isNotNull())
                                                .select("contest_id", "px"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------ I1 - I10 scalar functions
@register("scalar_strings", r"""
SELECT upper(url) AS u, lower(url) AS l, length(url) AS n, split_part(url, '/', 3) AS host,
       starts_with(url, 'https') AS https, regexp_matches(url, '\.com') AS dotcom,
       replace(url, 'www.', '') AS no_www, trim(regexp_replace('  ' || split_part(url, '/', 4) || '  ', '\s+', ' ', 'g')) AS seg
FROM pages
""")
def _scalar_strings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.upper("url").alias("u"), F.lower("url").alias("l"), F.length("url").alias("n"),
                    F.split_part("url", F.lit("/"), F.lit(3)).alias("host"),
                    F.startswith("url", F.lit("https")).alias("https"), F.col("url").rlike(r"\.com").alias("dotcom"),
                    F.replace("url", F.lit("www."), F.lit("")).alias("no_www"),
                    F.trim(F.regexp_replace(F.concat(F.lit("  "), F.split_part("url", F.lit("/"), F.lit(4)),
                                                     F.lit("  ")), r"\s+", " ")).alias("seg"))


@register("scalar_dates", """
SELECT event_id, CAST(ts AS DATE) AS d, strftime(ts, '%Y%m%d') AS ymd, CAST(ts AS DATE) + 7 AS d_plus,
       CAST(ts AS DATE) - 7 AS d_minus, year(ts) AS y, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS age_days,
       TRY_CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS reparsed
FROM events
""")
def _scalar_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = F.to_date("ts")
    return e.select("event_id", d.alias("d"), F.date_format("ts", "yyyyMMdd").alias("ymd"),
                    F.date_add(d, 7).alias("d_plus"), F.date_sub(d, 7).alias("d_minus"),
                    F.year("ts").alias("y"), F.datediff(d, F.lit("2024-01-01").cast("date")).alias("age_days"),
                    F.try_to_date(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd").alias("reparsed"))


@register("scalar_nulls", """
SELECT event_id, coalesce(nullif(event_type, 'error'), 'n/a') AS kind, value IS NULL AS missing,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v_or_null,
       coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0.0) AS v_filled
FROM events
""")
def _scalar_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") != "error", F.nanvl("value", F.lit(None).cast("double")))
    return e.select("event_id", F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("n/a")).alias("kind"),
                    F.isnull("value").alias("missing"), v.alias("v_or_null"),
                    F.coalesce(v, F.lit(0.0)).alias("v_filled"))


@register("scalar_json", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
def _scalar_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clean = F.regexp_replace("props", "^\ufeff", "")
    return e.select("event_id", F.from_json(clean, "k INT").getField("k").alias("k"))
