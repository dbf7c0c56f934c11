"""Sharding, mixing and winnowing against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastcast.llm import feistel, mixing, sharding, winnowing
from pastcast.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PYTHON = re.compile("Python|Pandas|Arrow")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 257, 1000])
def test_feistel_is_a_bijection_with_an_inverse(spark, n):
    rows = spark.range(n).select("id", feistel.permute(F.col("id"), F.lit(n), F.lit(3)).alias("y")).withColumn(
        "back", feistel.unpermute(F.col("y"), F.lit(n), F.lit(3))).collect()
    assert sorted(r.y for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n == 1000:
        other = spark.range(n).select(feistel.permute(F.col("id"), F.lit(n), F.lit(4)).alias("y")).collect()
        assert sum(a.y == b.y for a, b in zip(rows, other)) < 20


def test_shards_rows_law_and_round_trip(spark, odd_docs):
    slim = odd_docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    rows = sharding.assign_shards(slim, 8, 5).collect()
    n = odd_docs.count()
    assert len(rows) == n and sorted(r.row_number for r in rows) == list(range(n))
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    for shard in by:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(by[shard]))
    assert Counter((r.doc_id, r.c) for r in rows) == Counter((r.doc_id, r.c) for r in slim.collect())
    again = sharding.assign_shards(slim.repartition(5), 8, 5).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    place = spark.createDataFrame([(r.row_number, r.shard, r.slot) for r in rows], "n bigint, s int, t bigint")
    assert not place.filter(sharding.row_at(F.col("s"), F.col("t"), F.lit(n), 8, 5) != F.col("n")).head(1)


def test_shards_of_hot_rows_and_of_nothing(spark, no_docs):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id")).alias("doc_id"))
    rows = sharding.assign_shards(hot, 8).collect()
    assert sorted(r.row_number for r in rows) == list(range(3000))
    assert sharding.assign_shards(no_docs.select("doc_id"), 8).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark, odd_docs, odd_rows):
    sized = odd_docs.select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), mixing.word_count(F.col("text")).alias("size"))
    documents, sources, used = mixing.mix(sized)
    count = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in odd_rows:
        sizes[s] += count(t)
    expected = brute_targets(dict(sizes))
    got = {r.source_key: r for r in sources.collect()}
    assert len(got) == len(expected)
    for s, t in expected.items():
        row = got["1" if s is None else "0" + s]
        assert row.source_size == sizes[s] and math.isclose(row.target, t, abs_tol=1e-6)
    taken, by_doc = Counter(), Counter()
    for r in used.collect():
        assert r.uses in (1, 2) and 0 <= r.from_word and r.from_word + r.words <= r["size"]
        taken[r.source_key] += r.words * r.uses
        by_doc[r.doc_id, r.source_key, r["size"], r.copy] += r.words * r.uses
    assert all(n <= 2 * k[2] for k, n in by_doc.items())
    for k, row in got.items():
        assert abs(taken[k] - row.target) <= 2 * mixing.BLOCK
    assert documents.count() == len(odd_rows)
    again = mixing.mix(sized.repartition(3))[2]
    assert sorted(map(str, again.select(sorted(again.columns)).collect())) == sorted(map(str, used.select(sorted(used.columns)).collect()))


def test_mix_slots_fill_the_shards(spark, odd_docs):
    sized = odd_docs.select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), mixing.word_count(F.col("text")).alias("size"))
    _, sources = mixing.lay_out(sized)
    slots = mixing.draw_slots(sources, 8).collect()
    assert sorted(r.shard * mixing.SHARD_BLOCKS + r.slot for r in slots) == list(range(len(slots)))
    draws = {r.source_no: (r.draws, r.blocks) for r in sources.collect()}
    uses = Counter((r.source_no, r.block) for r in slots)
    assert Counter(r.source_no for r in slots) == {k: d for k, (d, _) in draws.items() if d}
    assert all(0 <= b < draws[s][1] for s, b in uses) and max(uses.values()) <= 2


def test_mix_draws_counts_and_numbers_slots_by_them(spark, monkeypatch):
    """Shards of eight slots: counts add up both ways, slots are numbered along the shards, numbers go through permutations."""
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    draws = {0: (90, 50), 1: (30, 40), 2: (0, 0), 3: (40, 20)}  # draws, blocks
    firsts = dict(zip(draws, np.cumsum([0, *(d for d, _ in draws.values())]).tolist()))
    sources = spark.createDataFrame([(k, firsts[k], d, b) for k, (d, b) in draws.items()], "source_no long, first_draw long, draws long, blocks long")
    slots = mixing.draw_slots(sources, 8)
    rows = sorted(slots.collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.shard, r.slot) for r in rows] == [(k // 8, k % 8) for k in range(160)]
    # the draw by hand: the k-th draw of all goes to the place that the permutation of all slots names
    places = spark.range(160).select("id", feistel.unpermute(F.col("id"), F.lit(160), F.lit(8)).alias("p")).collect()
    owner = {r.p: max(k for k in draws if firsts[k] <= r.id and draws[k][0]) for r in places}
    assert [r.source_no for r in rows] == [owner[k] for k in range(160)]
    assert {(r.shard, r.source_no): r.n for r in mixing.shard_counts(slots).collect()} == Counter((p // 8, s) for p, s in owner.items())
    for k, (d, b) in draws.items():
        own = [r for r in rows if r.source_no == k]
        assert [r.number for r in own] == list(range(d))
        for turn in range(0, d, b or 1):
            blocks = [r.block for r in own[turn:turn + b]]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(b)) and (len(blocks) < b or blocks != sorted(blocks))
    spread = Counter(sum(r.source_no == 0 for r in rows[a:a + 8]) for a in range(0, 160, 8))
    assert len(spread) >= 4  # not dealt evenly


def test_mix_plan_holds_the_draw(spark, odd_docs):
    from pastcast.llm.queries import QUERIES
    assert QUERIES["op8_mixing"]
    sized = odd_docs.select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.mix(sized)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and "slot" in plan and "Window" in plan


def test_mixed_documents_hold_the_words_taken(spark, odd_docs, no_docs):
    rows = mixing.mix_documents(odd_docs)
    assert rows.columns == odd_docs.columns
    texts = {(r.doc_id, r.source): r.text for r in odd_docs.collect()}
    for r in rows.collect():
        assert r.n_chars == len(r.text)
        words = WORD.findall(texts.get((r.doc_id, r.source)) or "")
        if r.doc_id not in (9, 10, None):
            it = iter(words)
            assert all(w in it for w in WORD.findall(r.text))  # the words in their order
    assert mixing.mix_documents(no_docs).count() == 0


def brute_fingerprint(spark, text, k=winnowing.K, w=winnowing.W):
    units = re.findall(winnowing.UNIT, text or "")
    if not units:
        return []
    grams = [units[i:i + k] for i in range(max(1, len(units) - k + 1))]
    hashes = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g array<string>").select(
        F.xxhash64(*[F.get("g", j) for j in range(k)])).collect()]
    order = [(h % (1 << 64)) >> 33 for h in hashes]
    kept = set()
    for i in range(max(1, len(order) - w + 1)):
        window = order[i:i + w]
        kept.add(max(j for j in range(i, i + len(window)) if order[j] == min(window)))
    return [(p, hashes[p]) for p in sorted(kept)]


def test_text_without_blanks_keeps_its_fingerprint_after_a_change(spark):
    rng = np.random.default_rng(3)
    han = "".join(chr(0x4E00 + k) for k in rng.integers(0, 3000, 3000))
    code = "".join(np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))[rng.integers(0, 64, 3000)])
    for text in (han, code):
        assert re.findall(winnowing.UNIT, text) and "".join(re.findall(winnowing.UNIT, text)) == text
        rows = spark.createDataFrame([(text, text[:9] + "x" + text[9:], text[:1500] + "qq" + text[1500:])], "a string, b string, c string")
        own = {n: winnowing.hashes(winnowing.fingerprint(F.col(n))) for n in "abc"}
        near = rows.select(winnowing.likeness(own["a"], own["b"]).alias("b"), winnowing.likeness(own["a"], own["c"]).alias("c")).first()
        assert near.b > 0.95 and near.c > 0.95
    assert re.findall(winnowing.UNIT, "a word, and another-word!\n") == ["a", "word,", "and", "another-word!"]


def test_winnowing_keeps_rightmost_minima(spark, odd_rows):
    texts = [t for _, t, _ in odd_rows if t is None or len(t) < 3000][:24] + ["a b a b a b a b a b a b a b a b a b a b a b a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(e.position, e.hash) for e in r.f] for r in rows.select("i", winnowing.fingerprint(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_fingerprint(spark, t)


def test_winnowing_guarantee(spark):
    shared = [f"s{i}" for i in range(winnowing.W + winnowing.K - 1)]
    rows = [(" ".join([f"a{j}{i}" for i in range(j * 3)] + shared + [f"b{j}{i}" for i in range(j)]),) for j in range(9)]
    got = [set(r[0]) for r in spark.createDataFrame(rows, "text string").select(
        winnowing.hashes(winnowing.fingerprint(F.col("text")))).collect()]
    assert all(a & b for a in got for b in got)


def write(df, folder):
    df.select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_op7_neighbours(spark, odd_docs, odd_rows, tmp_path):
    got = QUERIES["op7_winnowing"](spark, write(odd_docs, tmp_path)).collect()
    assert len(got) == len(odd_rows)
    rows = sorted({(i, t or "") for i, t, _ in odd_rows if i is not None}, key=lambda r: -r[0])
    ids = [i for i, _ in rows]
    seen = {(r.doc_id, r.n_chars): r for r in got}
    for at, (i, t) in enumerate(rows[:-1]):
        follows = rows[at + 1][0]
        if ids.count(i) > 1 or ids.count(follows) > 1:
            continue
        third = len(t) // 3
        edited = t[:len(t) - third] + rows[at + 1][1][:third]
        assert seen[i, len(t)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for (i, t) in rows:
        by_text.setdefault(t, set()).add(seen[i, len(t)].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_op7_single_and_no_document(spark, no_docs, tmp_path):
    from .conftest import as_docs
    assert QUERIES["op7_winnowing"](spark, write(no_docs, tmp_path / "none")).count() == 0
    one = QUERIES["op7_winnowing"](spark, write(as_docs(spark, [(5, "alone in the table", "a")]), tmp_path / "one")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("name", ["op5_sharding", "op7_winnowing", "op8_mixing"])
def test_native_queries_have_no_python_in_their_plans(spark, odd_docs, tmp_path, name):
    df = QUERIES[name](spark, write(odd_docs, tmp_path))
    assert not PYTHON.search(df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == odd_docs.count()


def test_op5_columns(spark, odd_docs, odd_rows, tmp_path):
    got = QUERIES["op5_sharding"](spark, write(odd_docs, tmp_path)).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
