"""Repair of conversation structure: the cheapest edits after which roles run ``(system? (user assistant)+)?``.

The pattern is an automaton of four states. A row costs what its edit costs, and leads from state to
state; a stretch of rows is summed up by ``Table``: for any two states the least cost between them, and
how the least audits to the different end states compare. Tables compose, so that a stretch is a row, some
rows, or a piece of a conversation that another task has summed up.

Hirschberg's divide and conquer rebuilds the edits: forward vectors of four costs from the start and backward
vectors from the end meet in the middle, the crossing with the audit-least left half among the optimal ones
is taken, and both halves are solved the same way. No more than the vectors of one stretch and the answer are held.

Two left halves that end in different states are never prefixes of each other: each ends with the edit of
the same row, insertions before that row included. So comparing left halves is enough, and for that their
order among four states is enough; no audit is ever built to be compared.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import joined_sha256, numbered
from .common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: at the start, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NONE = 1 << 40
#: Where a turn leads, if it may come.
_TURN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: After the last row: cost and turns still to insert, by state.
_TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "UA"), USER: (INSERT, "A"), ASSISTANT: (0, "")}
#: What is not white space.
SOLID = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Table:
    """``cost[a][b]`` from state a to b, and ``order[a][b]``: the place of its least audit among those from a."""

    cost: tuple
    order: tuple


def _actions(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For a row's code, the best (cost, action) from state to state. An action has the inserted turns (U, A) and
    the row's edit: K keep, u or a rerole, D delete."""
    initial, truncated, must_go = "?sua"[code & 3], TRUNCATED * (code >> 2 & 1), code >> 3 & 1
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for a in STATES:
        state, cost, inserted = a, 0, ""
        for _ in range(4):  # more insertions only lead round
            edits = [(DELETE, "D", state)]
            if not must_go:
                if state in _TURN.get(initial, {}):
                    edits.append((KEEP + truncated, "K", _TURN[initial][state]))
                edits += [(REROLE + truncated, r, _TURN[r][state]) for r in "ua" if state in _TURN[r]]
            for price, letter, b in edits:
                new = (cost + price, inserted + letter)
                if (a, b) not in found or (new[0], audit(new[1])) < (found[a, b][0], audit(found[a, b][1])):
                    found[a, b] = new
            turn = "a" if state == USER else "u"
            state, cost, inserted = _TURN[turn][state], cost + INSERT, inserted + turn.upper()
    return found


def audit(actions: str) -> str:
    """The edits' initials: insertions I, keeps K, reroles R, deletions D."""
    return actions.translate({ord("U"): "I", ord("A"): "I", ord("u"): "R", ord("a"): "R"})


#: By row code: initial (0 other, 1 s, 2 u, 3 a), 4 if truncated, 8 if blank or a duplicate.
_ACTIONS = [_actions(code) for code in range(16)]


def _row_table(code: int) -> Table:
    steps = _ACTIONS[code]
    names = {a: sorted({audit(x) for (s, _), (_, x) in steps.items() if s == a}) for a in STATES}
    return Table(tuple(tuple(steps.get((a, b), (_NONE, ""))[0] for b in STATES) for a in STATES),
                 tuple(tuple(names[a].index(audit(steps[a, b][1])) if (a, b) in steps else 0 for b in STATES) for a in STATES))


ROWS = [_row_table(code) for code in range(16)]


def forward(costs: Sequence[int], order: Sequence[int], table: Table) -> tuple[list[int], list[int]]:
    """The vector (costs, order of the least audits) one stretch further on."""
    out, keys = [_NONE] * 4, [(9, 9)] * 4
    for b in STATES:
        for a in STATES:
            cost = costs[a] + table.cost[a][b]
            key = (order[a], table.order[a][b])
            if cost < _NONE and (cost, key) < (out[b], keys[b]):
                out[b], keys[b] = cost, key
    places = sorted(set(keys))
    return out, [places.index(k) for k in keys]


def backward(costs: Sequence[int], table: Table) -> list[int]:
    """The least costs to the end, one stretch further back."""
    return [min(table.cost[a][b] + costs[b] for b in STATES) for a in STATES]


def _from(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else _NONE for s in STATES], [0] * 4


def crossings(tables: Sequence[Table], a: int, b: int) -> list[int]:
    """The states between stretches on the audit-least cheapest way from ``a`` to ``b``, by divide and conquer."""
    if len(tables) < 2:
        return []
    middle = len(tables) // 2
    left, right = _from(a), [0 if s == b else _NONE for s in STATES]
    for t in tables[:middle]:
        left = forward(*left, t)
    for t in reversed(tables[middle:]):
        right = backward(right, t)
    best = min(STATES, key=lambda s: (left[0][s] + right[s], left[1][s]))
    return [*crossings(tables[:middle], a, best), best, *crossings(tables[middle:], best, b)]


def finish(tables: Sequence[Table]) -> tuple[int, int]:
    """(cost, last state) of the audit-least cheapest repair; the turns of ``_TAIL`` follow."""
    end = _from(START)
    for t in tables:
        end = forward(*end, t)
    last = min(STATES, key=lambda s: (end[0][s] + _TAIL[s][0], end[1][s]))
    return end[0][last] + _TAIL[last][0], last


@functools.lru_cache(1 << 14)
def _short_actions(codes: bytes, a: int, b: int) -> tuple[str, ...]:
    states = [a, *crossings([ROWS[c] for c in codes], a, b), b]
    return tuple(_ACTIONS[c][x, y][1] for c, x, y in zip(codes, states, states[1:]))


def actions(codes: bytes, a: int, b: int) -> list[str]:
    """The action of every row of a stretch that leads from state ``a`` to ``b``."""
    if not codes:
        return []
    if len(codes) <= 64:
        return list(_short_actions(codes, a, b))
    at = range(0, len(codes), 64)
    states = [a, *crossings([summary(codes[i:i + 64]) for i in at], a, b), b]
    return [x for i, p, q in zip(at, states, states[1:]) for x in _short_actions(codes[i:i + 64], p, q)]


@functools.lru_cache(1 << 14)
def _short_summary(codes: bytes) -> Table:
    ways = [functools.reduce(lambda v, c: forward(*v, ROWS[c]), codes, _from(a)) for a in STATES]
    return Table(tuple(tuple(w[0]) for w in ways), tuple(tuple(w[1]) for w in ways))


def compose(first: Table, second: Table) -> Table:
    ways = [forward(first.cost[a], first.order[a], second) for a in STATES]
    return Table(tuple(tuple(w[0]) for w in ways), tuple(tuple(w[1]) for w in ways))


def summary(codes: bytes) -> Table:
    """The table of a stretch of at least one row."""
    return functools.reduce(compose, [_short_summary(codes[i:i + 64]) for i in range(0, len(codes), 64)])


def _flat(table: Table) -> list[int]:
    return [x for rows in (table.cost, table.order) for row in rows for x in row]


def _table(flat: Sequence[int]) -> Table:
    rows = [tuple(flat[i:i + 4]) for i in range(0, 32, 4)]
    return Table(tuple(rows[:4]), tuple(rows[4:]))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, turn, role, text, again): what faults leave of the rows. The remainder of crc32(``conv_id:turn``)
    by 20 decides: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    Nulls are written as one space; ``key`` is the id as a string."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    kept = rows.select(
        F.col(id_col).alias("conv_id"), space(id_col).alias("key"), F.col(turn_col).alias("turn"),
        F.when(fault == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"), fault.alias("fault")).filter("fault != 0")
    return kept.withColumn("again", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault")


def _classified(rows: DataFrame) -> DataFrame:
    """Adds where a row stands and its first fault: blank, duplicate, truncated."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]
    placed = numbered(rows.select("conv_id", "key", "turn", "role", "text", "again"), "key", order, "repair-turns")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = placed.withColumns({"same": same, "at": F.col("before") + F.col("place")})
    # Sum of a group's rows is combined before the shuffle; only what repeats comes back to the rows.
    repeated = placed.groupBy("key", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = placed.select("key", "same", "at", "piece").join(repeated, ["key", "same"]).filter("at > first").select(
        "key", "piece", "at", F.lit(True).alias("copy"))
    joined = placed.join(copies, ["key", "piece", "at"], "left")
    blank, copy = ~F.col("text").rlike(SOLID), F.coalesce("copy", F.lit(False))
    open_ = ~F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1).rlike("[.!?]")
    return joined.withColumns({"blank": blank, "duplicate": ~blank & copy, "truncated": ~blank & ~copy & open_}).drop("copy", "same", "first")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    return (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
            + F.when(F.col("truncated"), 4).otherwise(0) + F.when(F.col("blank") | F.col("duplicate"), 8).otherwise(0)).cast("int")


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, list]]:
    """Pieces (key, piece, codes) of rows (key, piece, code) sorted by piece and place."""
    now, held = None, []
    for batch in batches:
        keys, pieces, codes = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
        if not len(codes):
            continue
        coded = keys.dictionary_encode()
        numbers = coded.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (pieces[1:] != pieces[:-1])) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            mark = (coded.dictionary[int(numbers[a])].as_py(), int(pieces[a]))
            if mark != now:
                if now:
                    yield *now, b"".join(held)
                now, held = mark, []
            held.append(codes[a:b].tobytes())
    if now:
        yield *now, b"".join(held)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("piece", pa.int32()), ("codes", pa.binary()), ("table", pa.list_(pa.int64()))])
    yield from _batched(((key, piece, codes, _flat(summary(codes))) for key, piece, codes in _in_runs(batches)), schema)


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States where pieces begin and end, from rows (key, pieces, tables): what the pieces' tables tell together."""
    def rows():
        for batch in batches:
            for key, pieces, tables in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tables = [_table(t) for t in tables]
                cost, last = finish(tables)
                states = [START, *crossings(tables, START, last), last]
                for i, piece in enumerate(pieces):
                    yield key, piece, states[i], states[i + 1], i == len(pieces) - 1, cost
    yield from _batched(rows(), pa.schema([("key", pa.string()), ("piece", pa.int32()), ("a", pa.int32()), ("b", pa.int32()),
                                           ("final", pa.bool_()), ("cost", pa.int64())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for key, piece, codes, a, b, final, cost in zip(*(batch.column(i).to_pylist() for i in range(7))):
                todo = actions(codes, a, b)
                if final:
                    todo[-1] += _TAIL[b][1]
                yield key, piece, cost, todo, audit("".join(todo))
    yield from _batched(rows(), pa.schema([("key", pa.string()), ("piece", pa.int32()), ("cost", pa.int64()),
                                           ("todo", pa.list_(pa.string())), ("audit", pa.string())]), 512)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, reports) of conversations given as rows (conv_id, key, turn, role, text, again), as of ``damaged``.

    ``turns``: the repaired turns, each with key, piece, at (its row's place) and line (``role:text``). ``reports``: a
    row per key with gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Roles, texts, keys
    must not be null; ties in turn are ordered by role and text. A conversation of any length is worked on in pieces;
    what comes together are tables of 32 numbers a piece, the audit, and the hash state of its text.
    """
    at = materialise(_classified(rows).withColumn("code", _code()), "repair-rows")
    in_order = (at.select("key", "piece", F.col("code"), "place").repartition("key", "piece").sortWithinPartitions("key", "piece", "place")
                .select("key", "piece", "code"))
    pieces = materialise(in_order.mapInArrow(_summed, "key string, piece int, codes binary, table array<bigint>"), "repair-pieces")
    # The pieces of a conversation are as few as the ranges it spans.
    lists = F.array_sort(F.collect_list(F.struct("piece", "table")))
    states = pieces.groupBy("key").agg(lists.alias("x")).select("key", F.col("x.piece").alias("pieces"), F.col("x.table").alias("tables")).mapInArrow(
        _joined_up, "key string, piece int, a int, b int, final boolean, cost bigint")
    edits = materialise(pieces.select("key", "piece", "codes").join(states, ["key", "piece"]).select(
        "key", "piece", "codes", "a", "b", "final", "cost").mapInArrow(_edited, "key string, piece int, cost bigint, todo array<string>, audit string"),
        "repair-edits")
    return _lines(at, edits), _report(at, edits, _lines(at, edits))


def _lines(at: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired turns: a row's inserted turns before it, its own line, and what is inserted after the last."""
    acted = at.join(edits.select("key", "piece", "todo"), ["key", "piece"]).withColumn("todo", F.element_at("todo", (F.col("place") + 1).cast("int")))
    letters = F.split("todo", "")
    own = lambda role: F.concat(role, F.lit(":"), "text")
    line = lambda c: (F.when(c == "U", "user:").when(c == "A", "assistant:").when(c == "K", own(F.col("role")))
                      .when(c == "u", own(F.lit("user"))).when(c == "a", own(F.lit("assistant"))))
    lines = F.filter(F.transform(letters, line), lambda x: x.isNotNull())
    return acted.select("conv_id", "key", "piece", "at", F.posexplode(lines).alias("nth", "line"))


def _report(at: DataFrame, edits: DataFrame, lines: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    turns = at.groupBy("key").agg(F.max("turn").alias("high"), F.min("turn").alias("low"))
    distinct = at.filter("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1)).groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    counts = at.groupBy("key").agg(count("blank"), count("duplicate"), count("truncated"))
    # Neighbours within a piece, and the last row of a piece with the first of the next.
    initial = F.substring("role", 1, 1)
    beside = at.withColumn("initial", initial).withColumn("next", F.lead("initial").over(W.partitionBy("key", "piece").orderBy("place")))
    bad = lambda pair: (F.col("next").isNotNull() & ~pair.isin("su", "ua", "au")).cast("long")
    inner = beside.withColumn("bad", bad(F.concat("initial", "next")))
    edges = inner.groupBy("key", "piece").agg(F.sum("bad").alias("bad"), F.min_by("initial", "place").alias("head"), F.max_by("initial", "place").alias("initial"))
    edges = edges.withColumn("next", F.lead("head").over(W.partitionBy("key").orderBy("piece")))
    illegal = edges.groupBy("key").agg(F.sum(F.col("bad") + bad(F.concat("initial", "next"))).alias("illegal"))
    audits = edits.groupBy("key").agg(F.max("cost").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashes = joined_sha256(lines, ["key"], ["piece", "at", "nth"], "line", "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("different"), F.lit(0)).cast("long")
    return (counts.join(turns, "key").join(distinct, "key", "left").join(illegal, "key").join(audits, "key").join(hashes, "key", "left")
            .select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")))


def repair_report(original: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``reports`` of ``repair`` for every id of ``original``; zeros, an empty audit and the empty string's hash for those
    without ``rows``. Null ids are one conversation, with a null id. An empty table gives an empty report."""
    ids = original.select(F.col(id_col).alias("conv_id"), F.coalesce(F.col(id_col).cast("string"), F.lit(" ")).alias("key")).distinct()
    report = repair(rows)[1]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(report, "key", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
