"""Nearest neighbours, prefix trie and conversation repair against brute force."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.llm import hnsw, ordered, prefix_trie, repair

CONVS = "conv_id bigint, turn bigint, role string, text string, block string, key string, words string, piece string"


# ---------------------------------------------------------------- joined hashes
def test_joined_sha256(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(k, i, None if rng.random() < .1 else "x" * rng.randrange(5)) for k in ("", "a", "ü") for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(5)
    expected = {}
    for k in ("", "a", "ü"):
        expected[k] = hashlib.sha256("\n".join((t or "") for _, i, t in sorted(r for r in rows if r[0] == k)).encode()).hexdigest()
    assert {r[0]: r[1] for r in ordered.joined_sha256(df, ["k"], ["i"], "t", "\n").collect()} == expected
    monkeypatch.setattr(ordered, "PIECE", 7)
    assert {r[0]: r[1] for r in ordered.joined_sha256(df, ["k"], ["i"], "t", "\n").collect()} == expected
    assert ordered.joined_sha256(df.limit(0), ["k"], ["i"], "t", "\n").count() == 0


# ---------------------------------------------------------------- nearest neighbours
def brute_nearest(rows, k=5, every=50):
    real = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            real.setdefault((i, tuple(v)), np.array(v, float) / max(abs(x) for x in v))
    out = defaultdict(list)
    for (i, v), x in real.items():
        if i % every == 0:
            near = sorted({(-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 12), j)
                           for (j, w), y in real.items() if j != i and len(w) == len(v)})[:k]
            out[i] += [(j, -s) for s, j in near]
    return dict(out)


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, round(r.score, 12)))
    return dict(out)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(i, base[i % 60].tolist()) for i in range(400)]  # every direction six or seven times
    rows += [(1000 + i, (base[7] * (2.0 ** i)).tolist()) for i in range(20)]  # and scaled
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] + [1.0] * 7), (2200, [None] + [1.0] * 7), (2250, [float("inf")] * 8),
             (None, base[0].tolist()), (2300, [1e300] * 8), (2350, [1e-310] * 8), (2400, [1.0, 2.0]), (2401, [2.0, 1.0]), (2450, [3.0]), (0, base[0].tolist()), (-50, (-base[3]).tolist())]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, id string, node string").repartition(7)
    got = as_lists(hnsw.nearest(df, F.col("vec_id") % 50 == 0))
    expected = brute_nearest(rows)
    expected = {q: v for q, v in expected.items() if v}
    assert got == expected
    assert got[2400] == [(2401, round(0.8, 12))] and 2450 not in got and 2000 not in got
    empty = df.limit(0)
    assert hnsw.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert hnsw.nearest(df, F.lit(False)).count() == 0


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    tight = rng.normal(size=(1, 32)) + 0.05 * rng.normal(size=(1500, 32))  # near copies of one vector, a third of all
    x = np.concatenate([rng.normal(size=(3000, 32)), tight]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for size in (700, 5000):
        got = as_lists(hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_nodes=size))
        assert len(got) == 90
        hits = 0
        for q, found in got.items():
            s = unit @ unit[q]
            s[q] = -2
            assert len(found) == 5 and all(abs(score - s[i]) < 1e-9 for i, score in found)
            hits += len({i for i, _ in found} & set(np.argsort(-s)[:5].tolist()))
        assert hits / 450 >= 0.97, (size, hits / 450)


def test_graph_layers_and_links():
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = hnsw.build(x, seed=4)
    assert sorted(order.tolist()) == list(range(3000)) and len(graph.layers) >= 2
    back, ids = hnsw._unpack(hnsw._pack(graph, order))
    assert (ids == order).all() and all((a == b).all() for a, b in zip(graph.layers, back.layers))
    for table in graph.layers:
        for i, links in enumerate(table):
            real = links[links >= 0]
            assert len(set(real.tolist())) == len(real) and i not in real and (real < len(table)).all()
    again = hnsw.build(x, seed=4)[0]
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers))


# ---------------------------------------------------------------- prefix trie
def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(rows, every=20, heads=4):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = own.get(c - int(np.fmod(c, every)), [])
        made[c] = tuple(base[:h]) + tuple(own[c][h:])
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out = {}

    def below(n):
        if n not in out:
            leaves, saved = (0 if children[n] else 1), (len(members[n]) - 1) * (words(n[-1][1]) if n else 0)
            for c in children[n]:
                leaves, saved = leaves + below(c)[0], saved + below(c)[1]
            out[n] = leaves, saved
        return out[n]

    result = []
    for n in sorted(members, key=len, reverse=True):
        ends = ",".join(str(c) for c in sorted(c for c in members[n] if len(made[c]) == len(n)))
        result.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), *below(n),
                       hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=repr)


def conversations(seed, n=150, longest=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 300), n):
        size = rng.choice([1, 1, 2, 3, 5, 9, 17, rng.randrange(1, longest)])
        same = rng.random() < .4
        for t in range(size):
            text = f"turn {t} common" if same else rng.choice(["a", "b c", "", None, "d\te ", " "])
            rows.append((c, rng.choice([t, t, t, None, t + 5]), rng.choice(["user", "assistant"]) if not same else "user", text))
    return rows


def as_convs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONVS).repartition(6)


def trie(df):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_in_order(df)))


@pytest.mark.parametrize("stretch", [1024, 2])
def test_trie_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = conversations(stretch, longest=60) + [(None, 1, "user", "lost"), (500, None, None, None), (500, None, None, None), (501, 3, "user", "x" * 100_000)]
    got = trie(as_convs(spark, rows)).drop("n_ends").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


def test_trie_of_equal_and_turnless_conversations(spark):
    rows = [(c, 0, "user", "same words here") for c in range(1, 300)]  # h turns of an absent base: some have no turn
    got = trie(as_convs(spark, rows)).drop("n_ends").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)
    assert trie(as_convs(spark, [])).count() == 0


def test_heavy_parents_are_split(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    rows = conversations(9, 200)
    got = trie(as_convs(spark, rows)).drop("n_ends").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


# ---------------------------------------------------------------- conversation repair
def brute_repair(codes):
    """(cost, audit, output roles) by trying every script with at most three insertions in a row."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, roles
        if inserted < 3:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserted + 1)
        if i < len(codes):
            more = 1 if codes[i] & 4 else 0
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not codes[i] & 8:
                go(i + 1, roles + "?sua"[codes[i] & 3], cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_divide_and_conquer_against_all_scripts():
    rng = random.Random(5)
    for _ in range(600):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 3, 6, 7, 5, 8, 10, 4]) for _ in range(rng.randrange(7)))
        cost, last = repair.finish([repair.ROWS[c] for c in codes])
        done = "".join(repair.actions(codes, repair.START, last)) + repair._TAIL[last][1]
        assert (cost, repair.audit(done)) == brute_repair(codes)[:2], list(codes)


def test_pieces_give_what_the_whole_gives():
    rng = random.Random(6)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 2, 3, 6, 7, 5, 8, 10, 4]) for _ in range(rng.randrange(2, 300)))
        rows = [repair.ROWS[c] for c in codes]
        cost, last = repair.finish(rows)
        states = [0, *repair.crossings(rows, 0, last), last]
        whole = [repair._ACTIONS[c][a, b][1] for c, a, b in zip(codes, states, states[1:])]
        assert repair.actions(codes, 0, last) == whole
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, 3)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        tables = [repair.summary(p) for p in parts]
        assert repair.finish(tables) == (cost, last)
        states = [0, *repair.crossings(tables, 0, last), last]
        assert [x for p, a, b in zip(parts, states, states[1:]) for x in repair.actions(p, a, b)] == whole


def brute_report(rows):
    space = lambda x: " " if x is None else str(x)
    kept, out = defaultdict(list), {}
    for c, t, r, x in rows:
        fault, r, x = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, space(r), space(x)
        kept[c] += []
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        row = ((t is not None, t or 0), "user" if fault == 4 else r, x, t)
        kept[c] += [] if fault == 0 else [row, row] if fault == 3 else [row]
    for c, v in kept.items():
        v.sort(key=lambda row: row[:3])
        seen, counts, codes = set(), [0, 0, 0], []
        for _, r, x, _ in v:
            solid = x.strip(" \t\n\v\f\r")
            fault = 0 if not solid else 1 if (r, x) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((r, x))
            if fault < 3:
                counts[fault] += 1
            codes.append(("?sua".index(r[:1]) if r[:1] in ("s", "u", "a") else 0) + (4 if fault == 2 else 0) + (8 if fault < 2 else 0))
        cost, audit, roles = brute_repair(codes)
        lines, i, at = [], 0, 0
        names = {"s": "system", "u": "user", "a": "assistant"}
        for edit in audit:
            if edit == "I":
                lines.append(names[roles[at]] + ":")
            elif edit != "D":
                lines.append((v[i][1] if edit == "K" else names[roles[at]]) + ":" + v[i][2])
            at, i = at + (edit != "D"), i + (edit != "I")
        turns = [t for *_, t in v if t is not None]
        initials = [r[:1] for _, r, _, _ in v]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts,
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    got = repair.repair_report(df, repair.damaged(df)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in [None, *rng.sample(range(-20, 4000), 150)]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]),
                         rng.choice(["Hi.", "What? \n", "no end", "", " \t", None, "Wait! and", "é.", "x ", "." * 9, "y" * 20_000 + "."])))
    rows += rows[:20]
    assert report(as_convs(spark, rows)) == brute_report(rows)
    assert report(as_convs(spark, [])) == {}


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_long_conversation_in_pieces(spark, many_ranges):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "", "Yes."])) for t in range(2500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(2, 8) for t in range(4)]
    df = as_convs(spark, rows)
    at = repair._classified(repair.damaged(df))
    assert at.filter("key = '1'").select("piece").distinct().count() > 1
    got = report(df)
    small = brute_report([r for r in rows if r[0] > 1])
    assert {c: got[c] for c in small} == small
    # The long one: its pieces must give what one run over all of its rows gives.
    codes = bytes(r.code for r in at.withColumn("code", repair._code()).filter("key = '1'").orderBy("at").collect())
    cost, last = repair.finish([repair.ROWS[c] for c in codes])
    assert got[1][5:7] == (cost, repair.audit("".join(repair.actions(codes, 0, last)) + repair._TAIL[last][1]))
