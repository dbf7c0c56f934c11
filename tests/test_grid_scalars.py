"""Cell parsers and grid segmentation on hand-made micro grids (FIXTURES §5)."""
import datetime as dt

from pyspark.sql import functions as F

from pastcast.functions import scalars as S
from pastcast.operators import grid as G


def _one(spark, expr, value, dtype="STRING"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).collect()[0].y


def test_cell_parsers(spark):
    assert _one(spark, S.time_to_seconds, "1'34''37") == 94.37
    assert _one(spark, S.time_to_seconds, "34''37") == 34.37
    assert _one(spark, S.time_to_seconds, "abc") is None
    assert _one(spark, S.numeric_cell, "-") is None
    assert _one(spark, S.numeric_cell, "1.234,50") == 1.234
    assert _one(spark, S.numeric_cell, "55,5") == 55.5
    assert _one(spark, S.norm_name, "  maria   luz ") == "MARIA LUZ"
    assert _one(spark, S.parse_ddmmyy, "31/02/24") is None
    assert _one(spark, S.parse_ddmmyy, "05/03/79") == dt.date(2079, 3, 5)
    assert _one(spark, S.parse_ddmmyy, "05/03/80") == dt.date(1980, 3, 5)


def _row(n, **cells):
    c = [""] * n
    for k, v in cells.items():
        c[int(k[1:])] = v
    return c


def test_report_grid_parse(spark):
    W = 40
    rows = [
        _row(W, c1="x"),                                             # before first leader: dropped
        _row(W, c1="3", c4="Alpha Star", c30="55"),                  # leader block 1
        _row(W, c10="6 a.", c9="m."),                                 # age row +1
        _row(W, c1="Fecha"),                                         # header
        _row(W, c1="05/03/24", c4="MRÑ", c6="1", c18="55,5", c22="1600", c25="1'34''37", c28="3,2", c30="j doe"),
        _row(W, c1="31/02/24", c6="2"),                              # impossible date: rejected
        _row(W, c1="4", c4="Beta", c30="39.9"),                      # kg 39.9: not a leader
        _row(W, c1="2", c4="Gamma", c30="60"),                       # leader block 2 (no header): dropped
        _row(W, c1="01/01/24", c6="DSC"),
    ]
    cells = spark.createDataFrame([("Tabulada_RT1_20250126.xls", i, r) for i, r in enumerate(rows)],
                                  "file STRING, row INT, cells ARRAY<STRING>")
    out, rejects, metrics = G.parse_grid(cells)
    r = out.collect()
    assert len(r) == 1
    r = r[0]
    assert (r.entity_id, r.event_date, r.venue_id, r.finish_pos, r.label) == ("ALPHA STAR", dt.date(2024, 3, 5), 1, 1, 1)
    assert (r.load_kg, r.distance_m, r.total_time_s, r.dividend, r.rider_id) == (55.5, 1600, 94.37, 3.2, "J DOE")
    assert (r.horse_age, r.sex_code) == (5, "M")       # doc 2025, race 2024 -> one year back
    m = metrics.collect()[0]
    # the kg-39.9 row is not a leader, so it stays in block 1 as a skipped data row
    assert (m.n_blocks, m.n_history, m.n_skipped) == (1, 1, 2)


def test_age_scan_window_and_column_order(spark):
    W = 40
    rows = [_row(W, c1="1", c4="A", c30="50"), _row(W, c10="4 a.", c12="7 a."), _row(W, c1="Fecha")]
    rows += [_row(W) for _ in range(9)] + [_row(W, c10="9 a.")]
    cells = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file STRING, row INT, cells ARRAY<STRING>")
    meta = G.block_meta(G.blocks(cells)).collect()[0]
    assert meta.horse_age == 4                          # col 10 wins over col 12 on the same row


def test_segment_across_chunks(spark):
    df = spark.createDataFrame([("f", i, i in (3, 9)) for i in range(12)], "file STRING, row INT, st BOOLEAN")
    seg = G.segment(df, ["file"], "row", F.col("st"), chunk=4).orderBy("row").collect()
    assert [r.seg_start for r in seg] == [None] * 3 + [3] * 6 + [9] * 3
    assert [r.seg_no for r in seg] == [None] * 3 + [1] * 6 + [2] * 3


def test_day_card_and_votes(spark):
    W = 26
    rows = {i: _row(W) for i in range(32)}
    rows[7] = _row(W, c25="14:30")                         # time 3 rows above the first header
    rows[10] = _row(W, c7="PREMIO: Uno")
    rows[11] = _row(W, c0="1a", c2="Alpha", c11="55", c14="m.", c15="4", c16="J Doe")
    rows[12] = _row(W, c0="2", c2="Beta", c11="39", c14="h.")
    rows[13] = _row(W, c0="3", c2="Gamma", c11="56", c14="x")
    rows[30] = _row(W, c7="premio: Dos")
    rows[31] = _row(W, c0="1", c2="Delta", c11="57", c14="")
    cells = spark.createDataFrame([("card", i, r) for i, r in rows.items()],
                                  "file STRING, row INT, cells ARRAY<STRING>")
    con = G.card_contests(cells)
    hdr = {r.contest_no: r.start_time for r in con.select("contest_no", "start_time").distinct().collect()}
    assert hdr == {1: "14:30", 2: None}
    ent = {r.entity_name: r for r in G.entry_rows(con).collect()}
    assert set(ent) == {"Alpha", "Gamma", "Delta"}           # kg 39 dropped
    assert ent["Alpha"].post_position == 1 and ent["Alpha"].sex_code == "M" and ent["Gamma"].sex_code == "H"
    assert ent["Delta"].sex_code is None and ent["Alpha"].horse_age == 4
    d = spark.createDataFrame([("card", 1, 1600)], "file STRING, seq INT, distance_m INT")
    z = {r.contest_no: r.distance_m for r in G.ordinal_zip(con, d).collect()}
    assert z == {1: 1600, 2: 0}                               # short list padded with 0
    rd = spark.createDataFrame([("img", 1, "1600 mts"), ("img", 2, "(1600mts)"), ("img", 3, "7000 mt"),
                                ("tie", 1, "1200 mt"), ("tie", 2, "1000 mt"), ("none", 1, "abc")],
                               "image_id STRING, seq INT, text STRING")
    v = {r.image_id: r.value for r in G.modal_vote(rd, ["image_id"], "seq", "text").collect()}
    assert v == {"img": 1600, "tie": 1200, "none": None}


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([("A", 1, None, 2, "b.xls", 5), ("A", 1, None, 1, "a.xls", 9),
                                ("A", 1, 3, 0, "a.xls", 1)],
                               "e STRING, d INT, v INT, x INT, source_file STRING, source_row INT")
    out = {(r.v, r.x) for r in G.dedup_keep_first(df, ["e", "d", "v"], ["source_file", "source_row"]).collect()}
    assert out == {(None, 1), (3, 0)}                         # NULL keys compare equal


def test_score_day_card_end_to_end(spark):
    import datetime as dt
    from pastcast.operators import score as SC
    W = 26
    rows = {i: _row(W) for i in range(20)}
    rows[2] = _row(W, c7="PREMIO: Uno")
    rows[3] = _row(W, c0="1", c2="Alpha", c11="55", c14="m", c15="4", c16="Ann")
    rows[4] = _row(W, c0="2", c2="Bravo", c11="57", c14="h", c15="5", c16="Bob")
    rows[10] = _row(W, c7="PREMIO: Dos")                         # empty contest: no record
    f = "Programa_RT1_20240601.xls"
    cells = spark.createDataFrame([(f, i, r) for i, r in rows.items()], "file STRING, row INT, cells ARRAY<STRING>")
    readings = spark.createDataFrame([(f, 1, "1600 mts"), (f, 1, "1600mt"), (f, 2, "no reading")],
                                     "file STRING, seq INT, text STRING")
    hist = spark.createDataFrame(
        [("ALPHA", dt.date(2024, 5, 1), 1, 1, 55.0, 1600, "ANN"), ("BRAVO", dt.date(2024, 5, 1), 1, 6, 56.0, 1600, "BOB")],
        "entity_id STRING, event_date DATE, venue_id INT, finish_pos INT, load_kg DOUBLE, distance_m INT, rider_id STRING")
    out = SC.score_day_card(cells, readings, hist, SC.DEMO_SCORER).collect()
    assert len(out) == 1 and out[0].contest_no == 1 and out[0].n_entries == 2
    names = [e.entity_id for e in out[0].entries]
    assert names == ["ALPHA", "BRAVO"]                        # ALPHA placed 1st before: ranked first
    assert [e.rank for e in out[0].entries] == [1, 2]


def _brute_segment(rows):
    out, seen = [], {}
    for part, order, st in sorted(rows):
        last, n = seen.get(part, (None, 0))
        if st:
            last, n = order, n + 1
        seen[part] = (last, n)
        out.append((part, order, last, n if n else None))
    return sorted(out, key=str)


def test_segment_of_sparse_rows_in_small_and_large_parts(spark):
    """Rows far apart: a part of at most ``chunk`` rows is one chunk, larger ones carry the last start on."""
    rows = [(p, o * 10 ** 12, st) for p, n in (("a", 3), ("b", 40), ("c", 0)) for o, st in
            ((i, i % 7 == 2) for i in range(n))] + [("d", 5 * 10 ** 18, True), ("d", 1, False)]
    df = spark.createDataFrame([*rows, (None, 1, True), ("a", None, True)], "p STRING, o BIGINT, st BOOLEAN")
    want = sorted(((p, o, s, n + (p == "a") if n else n) for p, o, s, n in _brute_segment(rows)), key=str)  # a's start without o
    for chunk in (4, 10 ** 13, 1000):
        got = G.segment(df, ["p"], "o", F.col("st"), chunk=chunk).select("p", "o", "seg_start", "seg_no").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_parse_grid_deals_out_no_cells(spark):
    """What a row's cells say is read before rows are dealt out: no exchange has the cells."""
    cells = spark.createDataFrame([("R_RT1_20010315.xls", 1, [""] * 35)], "file STRING, row BIGINT, cells ARRAY<STRING>")
    for df in G.parse_grid(cells):
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        inputs = [part.split("\n")[1] for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0]]
        assert inputs and not any("cells#" in line for line in inputs)


def test_trimmed_is_white_space_of_any_script(spark):
    from pastcast.functions.scalars import _SPACE, numeric_cell, parse_ddmmyy, trimmed
    odd = [chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x85, 0xA0, 0x180E, 0x200B, 0x202F, 0x2060)]
    texts = [a + "x y" + b for a in odd for b in (*odd[:3], "")] + [" \n", "", None, "\u00a0 1,5 \u3000", " - ", "—", "05/06/99\u2028", "5/6/99", "05/06/099"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(
        "t", trimmed("t").alias("a"), F.regexp_replace("t", f"^{_SPACE}|{_SPACE}$", "").alias("b"), numeric_cell("t").alias("n"),
        parse_ddmmyy("t").cast("string").alias("d")).collect()
    assert all(r.a == r.b for r in df)
    assert [(r.n, r.d) for r in df[-7:]] == [(None, None), (1.5, None), (None, None), (None, None), (5.0, "1999-06-05"), (5.0, None), (5.0, "0099-06-05")]


def test_score_day_card_reads_the_sheets_once(spark):
    """The contests and the targets are kept: the result's own plan has no window that cuts sheets."""
    from pastcast.operators import score as SC
    rows = {2: _row(26, c7="PREMIO: Uno"), 3: _row(26, c0="1", c2="Alpha", c11="55", c14="m", c15="4", c16="Ann")}
    f = "Programa_RT1_20240601.xls"
    cells = spark.createDataFrame([(f, i, r) for i, r in rows.items()], "file STRING, row INT, cells ARRAY<STRING>")
    readings = spark.createDataFrame([(f, 1, "1600 mts")], "file STRING, seq INT, text STRING")
    hist = spark.createDataFrame([("ALPHA", dt.date(2024, 5, 1), 1, 1, 55.0, 1600, "ANN")],
                                 "entity_id STRING, event_date DATE, venue_id INT, finish_pos INT, load_kg DOUBLE, distance_m INT, rider_id STRING")
    out = SC.score_day_card(cells, readings, hist, SC.DEMO_SCORER)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_st#" not in plan and "cells[7]" not in plan and len(out.inputFiles()) > 0
    assert [r.n_entries for r in out.collect()] == [1]
