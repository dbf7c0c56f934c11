"""The other operators against brute force, exact round trips and held-out accuracy."""
import fnmatch
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from pastcast.llm import components, decontamination, simhash, substring_dedup, token_counts, token_store, toxicity, url_filter
from pastcast.llm.common import shared_path
from pastcast.llm.pieces import WordCoder, strip_word
from pastcast.llm.tokens import Encoder, default_path

from .conftest import as_docs, prose

HOSTS = ["example.org", "www.example.org", "xexample.org", "a.com", "b.a.com", "com", "net", "", "casino.net", "Ü.com"]
PATHS = ["", "/", "/en/1", "/en/12", "/en/", "/es/x", "/fr/a", "/de/", "/a.org/", "/" + "y" * 300]


def brute_rule(host, path, rules):
    fits = [r for r in rules if fnmatch.fnmatchcase("." + host, r.host_glob) and fnmatch.fnmatchcase(path, r.path_glob)]
    return min(fits, key=lambda r: (-r.rank, r.name), default=None)


def test_automaton_against_fnmatch():
    rules = [*url_filter.DOMAIN_RULES, *url_filter.GLOB_RULES, url_filter.glob_rule("*", "/?/*"), url_filter.glob_rule("*a*a*", "*b"),
             url_filter.glob_rule("." + "long" * 40, "*"), url_filter.glob_rule("*", "*" + "y" * 90)]
    automaton = url_filter.Automaton(rules)
    assert automaton.words > 3
    cases = [(h, p) for h in [*HOSTS, "banana", "long" * 40, "long" * 39] for p in [*PATHS, "/q/z", "ab"]]
    won = automaton.winners([b"." + h.encode() + url_filter.SPLIT + p.encode() for h, p in cases])
    for (h, p), k in zip(cases, won):
        expected = brute_rule(h, p, rules)
        assert (automaton.rules[k] if k >= 0 else None) == expected, (h, p)


def test_no_rules_and_no_urls():
    assert url_filter.Automaton([]).winners([b"x"]).tolist() == [-1]
    assert url_filter.Automaton(url_filter.DOMAIN_RULES).winners([]).tolist() == []


def test_filter_urls(spark):
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "x", "HTTPS://") for h in HOSTS for p in PATHS for q in ("", "?a=/fr/://", "#z")]
    urls += [None, "", "://", "http://A.COM/FR/", "http://a.com/fr/\n?", "http://a://b/c"]
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(urls + urls[:3])], "page_id int, url string, host string, verdict string")
    got = url_filter.filter_urls(df, [*url_filter.DOMAIN_RULES, *url_filter.GLOB_RULES]).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        rule = brute_rule(host, path, [*url_filter.DOMAIN_RULES, *url_filter.GLOB_RULES])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((rule.name, rule.verdict) if rule else (None, "allow"))
    assert url_filter.filter_urls(df.limit(0), url_filter.DOMAIN_RULES).count() == 0


def test_piece_memories_are_bounded_by_bytes(monkeypatch):
    from pastcast.llm import tokens
    rng = random.Random(2)
    long = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(70)) for _ in range(5000)]  # text without blanks
    short = [f"w{rng.randrange(10 ** 9)}" for _ in range(20_000)]
    texts = [" ".join(long[i:i + 50]) for i in range(0, 5000, 50)] + [" ".join(short[i:i + 100]) for i in range(0, 20_000, 100)]
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 200_000)
    monkeypatch.setattr(toxicity, "MEMORY_BYTES", 200_000)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 20_000)
    encoder, coder, grammar = tokens.Encoder(), WordCoder(lambda words: np.array([zlib.crc32(w.encode()) for w in words], np.int64)), toxicity.Grammar()
    whole, at = Tokenizer.from_file(default_path()), 0
    ids, ends = encoder.encode(pa.array(texts))
    for text, end in zip(texts, ends):
        assert ids[at:end].tolist() == whole.encode(text, add_special_tokens=False).ids
        at = end
    numbers, stops = coder.code(pa.array(texts))
    assert numbers.tolist() == [zlib.crc32(strip_word(w).encode()) for t in texts for w in t.split(" ")] and stops[-1] == len(numbers)
    grammar.features(pa.array(texts))
    for known in (encoder.slots, grammar.known):
        assert max(map(len, known)) <= 64 and sum(len(p) + 150 for p in known) <= 200_000


def test_all_white_space_parts_words():
    grammar = toxicity.Grammar()
    said = "you are a stupid idiot and a worthless moron"
    plain = grammar.features(pa.array([said]))
    for space in "\t\x0b\x0c\r\u00a0\u2003\u3000\x85":
        assert (grammar.features(pa.array([said.replace(" ", space)])) == plain).all(), repr(space)


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(3)
    alphabet = [*" \n\t  ab.é1'<\x85\u00a0\u3000\x1c", "  ", "日本", "🙂", "<|endoftext|>", "don't", " \n\n "]
    end = "<|endoftext|>"
    texts = ["", None, " ", "\n", end, end * 2, f" {end}", f"a{end}b", f"{end}\n\n{end} ", "<|endoftext", "é" * 200]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, ends = encoder.encode(pa.array(texts))
    whole = Tokenizer.from_file(default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    begin = 0
    for t, w, end in zip(texts, whole, ends):
        assert ids[begin:end].tolist() == w.ids, repr(t)
        assert encoder.byte_lengths[ids[begin:end]].sum() == len((t or "").encode())
        begin = end


def test_memory_of_pieces_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr("pastcast.llm.tokens.MEMORY_BYTES", 8000)
    rng = random.Random(5)
    texts = [prose(rng, 60) + "\n \n  x  y" * (k % 2) for k in range(40)]
    for k in range(0, 40, 7):
        ids, ends = encoder.encode(pa.array(texts[k:k + 7]))
        whole = encoder.tokenizer.encode_batch(texts[k:k + 7], add_special_tokens=False)
        assert ids.tolist() == [i for w in whole for i in w.ids]


def test_full_memory_of_pieces_keeps_the_first_ones(encoder, monkeypatch):
    """When the memory is full, the pieces met first stay, and the ids of all texts are right."""
    monkeypatch.setattr("pastcast.llm.tokens.MEMORY_BYTES", 30_000)
    monkeypatch.setattr("pastcast.llm.tokens.KEPT_BYTES", 8000)
    encoder._forget()
    rng = random.Random(6)
    common = " ".join(f"often{k}" for k in range(20))
    for k in range(30):
        texts = [common, f" lead {common}", *(" ".join(f"w{rng.random()}" for _ in range(30)) + "  \n " * (i % 2) for i in range(4)), None]
        ids, ends = encoder.encode(pa.array(texts))
        whole = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert ids.tolist() == [i for w in whole for i in w.ids] and ends.tolist() == np.cumsum([len(w.ids) for w in whole]).tolist()
        assert encoder.size <= 38_000 and all(f"often{k}" in encoder.slots for k in range(1, 20))
    encoder.rest()
    assert 0 < encoder.size <= 8000


def test_words_come_from_arrow_at_once(encoder):
    """Words of Arrow's dictionary are Python strings in its order, whatever they hold; odd words are learned alone."""
    import pyarrow as pa
    from pastcast.llm.tokens import _strings
    odd = ["", "a", "\x00", "b\x00c", "\u00a0", "\u2003x", "x\x1f", "\U0001f600", "\ufb01n", "\ud7ff", "d\n", "\u0085e"]
    for kind in (pa.string(), pa.large_string()):
        words = pa.array(odd, kind)
        assert _strings(words) == words.to_pylist() and _strings(words.slice(3, 4)) == odd[3:7] and _strings(words.slice(0, 0)) == []
    texts = [" ".join(odd), *(f"{w} {w}x {w}" for w in odd), None]
    ids, ends = encoder.encode(pa.array(texts))
    for text, at, end in zip(texts, [0, *ends.tolist()], ends.tolist()):
        assert ids[at:end].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_rules(rule):
    rng = random.Random(rule)
    for _ in range(200):
        size = rng.randrange(1, 40)
        cut = lambda k: np.array(sorted({*(rng.randrange(1, size + 1) for _ in range(k)), size}))
        token_ends, section_ends = cut(rng.randrange(12)), np.sort(np.concatenate([cut(rng.randrange(8)), rng.choices(range(size + 1), k=2)]))
        counts, crossing = token_counts.allocate(token_ends, section_ends, rule)
        expected, across = np.zeros(len(section_ends)), np.zeros(len(section_ends))
        for a, b in zip([0, *token_ends[:-1]], token_ends):
            overlap = np.maximum(0, np.minimum(b, section_ends) - np.maximum(a, np.concatenate([[0], section_ends[:-1]])))
            own = np.flatnonzero(overlap)
            across[own] += len(own) > 1
            if rule == "split":
                expected += overlap / (b - a)
            else:
                expected[{"start": own[0], "end": own[-1], "largest": int(np.argmax(overlap))}[rule]] += 1
        assert np.allclose(counts, expected) and (crossing == across).all()


def test_token_counts_of_lines(spark, odd_docs, odd_rows, encoder):
    texts = [(200 + k, "a\n\n\nb \n\n c\n" * k, "a") for k in range(4)]
    got = token_counts.count_tokens(as_docs(spark, [*odd_rows, *texts]), rule="start").collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, _ in [*odd_rows, *texts]:
        if i in (None, 9, 10):
            continue
        lines = (t or "").splitlines(keepends=True) if "\n" in (t or "") else [t or ""]
        rows = sorted(by[i], key=lambda r: r.section)
        assert [r.end_char - r.start_char for r in rows] == [len(x) for x in lines]
        assert sum(r.n_tokens for r in rows) == len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert any(r.n_crossing for r in got)


def test_token_counts_of_fields(spark, encoder):
    df = spark.createDataFrame([(1, "A title", "the body of it", None), (None, None, None, None), (2, "", "x\n\n", "y")],
                               "id int, title string, body string, size string")
    got = token_counts.count_tokens(df, id_col="id", fields=["title", "body", "size"], rule="split").collect()
    assert Counter(r.id for r in got) == {1: 3, None: 3, 2: 3}
    for i, whole in ((1, "A title\nthe body of it\n"), (2, "\nx\n\n\ny")):
        assert abs(sum(r.n_tokens for r in got if r.id == i) - len(encoder.tokenizer.encode(whole, add_special_tokens=False).ids)) < 1e-9
    assert token_counts.count_tokens(df.limit(0), id_col="id", fields=["title"]).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, rule="none")


def test_token_store_round_trip(spark, odd_docs, odd_rows, encoder):
    path = shared_path(spark, "test-store")
    token_store.write_store(odd_docs, path)
    got = token_store.read_store(spark, path).collect()
    ids = lambda t: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t, _ in odd_rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    one = token_store.read_document(spark, path, 4).collect()
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in one] == [ids(t) for i, t, _ in odd_rows if i == 4]


def test_large_memory_of_pieces_is_not_kept_after_a_task(encoder, monkeypatch):
    encoder.encode(pa.array(["some words of a task"]))
    encoder.rest()
    assert encoder.slots
    monkeypatch.setattr("pastcast.llm.tokens.KEPT_BYTES", 100)
    encoder.rest()
    assert not encoder.slots and encoder.size == 0
    ids, ends = encoder.encode(pa.array(["some words of a task"]))
    assert ids.tolist() == encoder.tokenizer.encode("some words of a task", add_special_tokens=False).ids


def test_token_store_sends_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """A batch of long texts is bounded by bytes, a segment goes on over batches, and the setting is as before."""
    monkeypatch.setattr("pastcast.llm.token_store.GROUP_BYTES", 1 << 16)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))
    seen = []
    write = token_store.setting
    monkeypatch.setattr(token_store, "setting", lambda spark, name, value: seen.append((name, value)) or write(spark, name, value))
    token_store.write_store(docs, str(tmp_path / "store"))
    assert seen == [(name, 1 << 16)] and spark.conf.get(name, None) == before
    segments = spark.read.parquet(str(tmp_path / "store" / "segments"))
    assert segments.selectExpr("sum(size(doc_ids))").first()[0] == 60
    assert segments.count() == segments.select("part").distinct().count()


def test_token_store_of_nothing_and_of_one(spark, no_docs):
    path = shared_path(spark, "test-store")
    token_store.write_store(no_docs, path)
    assert token_store.read_store(spark, path).count() == 0
    path = shared_path(spark, "test-store")
    token_store.write_store(as_docs(spark, [(1, "", "a")]), path)
    assert [(r.start, r.n_tokens) for r in token_store.read_store(spark, path).collect()] == [(0, 1)]


def brute_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark, odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    short = [(i, t) for i, t, _ in odd_rows if t is None or len(t) < 20_000]
    prints = {t: brute_simhash(t) for _, t in short}
    assert len(got) == len(odd_rows)
    expected = Counter((i, prints[t]) for i, t in short)
    assert not expected - Counter((r.doc_id, r.fingerprint % (1 << 64)) for r in got)
    nodes = {(i, r) for i, r in ((r.doc_id, r.fingerprint % (1 << 64)) for r in got)}
    values = sorted({f for _, f in nodes})
    root = components_of([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4], values)
    least = {}
    for i, f in nodes:
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    assert {(r.doc_id, r.fingerprint % (1 << 64)): r.component_id for r in got} == {(i, f): least[root[f]] for i, f in nodes}
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("cell", [2048, 40])
def test_pigeonring_loses_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint bigint")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.link_fingerprints(df, 4).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges) and len(edges) < 20 * len(values)
    expected = components_of([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4], values)
    assert components_of(edges, values) == expected


def test_keep_one_of_each_group(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = simhash._grouped(odd_docs, "doc_id", "text", 4, 4, 42)
    assert kept.count() == groups.select("component").distinct().count()
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[4] == 1 and not ids[5] and not ids[10] and ids[1] == 1 and not ids[2]
    assert simhash.keep_one(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2064)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: c for n, c in components_of(pairs, {x for p in pairs for x in p}).items() if n in nodes}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_clauses():
    symbols = lambda text: [toxicity.Grammar().look_up(w)[:2] for w in text.split()]
    read = lambda text: dict(zip(toxicity.KINDS, toxicity.read_clause(*map(list, zip(*symbols(text))))))
    assert read("you are an idiot")["targeted"] == toxicity.SEED_WEIGHT
    assert read("what an idiot")["asserted"] == toxicity.SEED_WEIGHT
    assert read("you are not an idiot")["negated"] == toxicity.SEED_WEIGHT
    assert read("he called her an idiot")["reported"] == toxicity.SEED_WEIGHT
    assert read("I will kill")["threat"] == 2 * toxicity.SEED_WEIGHT
    assert not any(read("a fine day").values())


def toxic_corpus(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        words, toxic = prose(rng, rng.randrange(5, 120)).split(), int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(("vok" + rng.choice("abcd") + "x", "zubbl", "idiot")))
        docs.append((i, " ".join(words), "a"))
        labels.append((i, 1, toxic))
    docs += [(900, None, "a"), (901, "", "a"), (902, "fine " * 9000, "a"), (None, "idiot", "a"), (3, docs[3][1], "a")]
    return as_docs(spark, docs), spark.createDataFrame([*labels, (900, 1, None), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    grammar = toxicity.learn(docs, labels)
    assert "zubbl$" in grammar.stems and any(s.startswith("vok") and len(s) <= 4 for s in grammar.stems)
    got = toxicity.score_texts(docs, grammar).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r.predicted == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a.stems == b.stems and np.allclose(a.curve, b.curve)


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    grammar = toxicity.learn(odd_docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score_texts(odd_docs, grammar).count() == odd_docs.count()
    assert toxicity.score_texts(no_docs, grammar).count() == 0


def leak_corpus(spark):
    rng = random.Random(23)
    items = [(k, prose(rng, rng.randrange(15, 60)) + ". " + prose(rng, rng.randrange(1, 12)) + ".") for k in range(30)]
    items += [(30, "a b."), (31, prose(rng, 200)), (32, None), (33, ""), (5, items[5][1]), (34, "No. Z9q.")]
    docs, planted = [], set()
    for i in range(150):
        words = prose(rng, rng.randrange(0, 400)).split()
        if i % 3 == 0:
            k = (i // 3) % 30
            at = rng.randrange(len(words) + 1)
            words[at:at] = items[k][1].upper().split() if i % 2 else items[k][1].split()
            planted.add((i, k))
        if i == 70:
            words[3:3] = items[31][1].split()
            planted.add((70, 31))
        if i == 71:  # the question without its answer
            words[3:3] = items[2][1].split(". ")[0].split()[:-8]
        docs.append((i, " ".join(words), "a"))
    return as_docs(spark, [*docs, (900, None, "a"), (901, "", "a"), (None, items[3][1], "b"), (902, prose(rng, 30_000), "a")]), items, planted


def brute_leaks(docs, items):
    """Every document against every item, by the same definition of a leak but without any index."""
    found = set()
    for i, text, *_ in docs:
        words = decontamination.words_of(text)
        for k, item in items:
            question, answer = decontamination.question_and_answer(item)
            if not question + answer:
                continue
            size = len(question) + len(answer)
            for at in range(0, max(1, len(words) - 1), 16):
                here = words[at:at + size + 96]
                there = {tuple(here[x:x + n]) for n in {5, len(question), len(answer)} for x in range(len(here) - n + 1)}
                asked, said = (len(s & there) >= 0.8 * len(s) for s in (decontamination.shingles(question), decontamination.shingles(answer)))
                if 5 <= len(answer) < 10:  # a short answer also counts by its words
                    said |= sum(w in here for w in answer) >= 0.8 * len(answer)
                if asked and said:
                    found.add((i, k))
    return found


def test_last_units_and_short_answers(spark):
    rng = random.Random(31)
    words = [f"q{k}" for k in range(64)]
    items = [(1, " ".join([*words, "the"])), (2, " ".join(f"s{k}" for k in range(30))), (3, " ".join(f"t{k}" for k in range(130)))]
    docs, planted = [(k, "the " + prose(rng, 50)) for k in range(40)], set()  # the last word of item 1, and no more
    for k, (i, text) in enumerate(items):
        said = text.split()
        # one word edited near the end; in the middle of a short question it spoils more than a fifth of the shingles
        for at in (len(said) - 1, len(said) - 3, len(said) - 5, *[len(said) // 2] * (len(said) > 60)):
            edited = [*said[:at], "other", *said[at + 1:]]
            docs.append((100 + len(docs), prose(rng, 40) + " " + " ".join(edited) + " " + prose(rng, 40)))
            planted.add((docs[-1][0], i))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.find_leaks(as_docs(spark, [(i, t, "a") for i, t in docs]), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    index = next(decontamination.indexes(table, "item_id", "text"))
    the = np.array([index.terms["the"]])
    assert not len(index.retrieve(np.zeros(1, np.int64), the, 1)[0])


def test_leaks(spark):
    docs, items, planted = leak_corpus(spark)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, table).collect()}
    assert planted <= got
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id != 902]
    brute = brute_leaks(rows, [x for x in items if x[0] in range(0, 30)])
    assert {(i, k) for i, k in got if k < 30 and i != 902} == brute
    clean = {r.doc_id for r in decontamination.remove_leaks(docs, table).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {i for i, _ in got}


def test_leaks_in_slices_and_of_nothing(spark, no_docs, odd_docs, monkeypatch):
    docs, items, planted = leak_corpus(spark)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, table).collect())
    monkeypatch.setattr(decontamination, "SLICE_WORDS", 500)
    assert Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, table).collect()) == whole
    assert decontamination.find_leaks(no_docs, table).count() == 0
    nothing = table.filter("item_id > 99")
    assert decontamination.find_leaks(odd_docs, nothing).count() == 0
    assert decontamination.remove_leaks(odd_docs, nothing).count() == odd_docs.count()


def test_block_max_bounds_skip_nothing():
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randrange(3, 150), 60)) for k in range(90)]
    words = [decontamination.words_of(t) for _, t in items]
    df = Counter(w for x in words for w in set(x))
    index = decontamination.BlockMaxIndex(items, df, len(items), sum(map(len, words)) / len(items))
    queries = [sorted({index.terms[w] for w in decontamination.words_of(prose(rng, 60, 60)) if w in index.terms}) for _ in range(80)]
    passage = np.repeat(np.arange(80), [len(q) for q in queries])
    got = set(zip(*(x.tolist() for x in index.retrieve(passage, np.array([t for q in queries for t in q]), 80)[:2])))
    exact = np.zeros((80, len(index.owner)))
    for q, terms in enumerate(queries):
        _, unit, weight = index.postings.expand(np.array(terms))
        np.add.at(exact[q], unit, weight)
    sure = {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= decontamination.THRESHOLD + 1e-9))}
    assert sure and sure <= got and got <= {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= decontamination.THRESHOLD - 1e-9))}


def test_compact_windows_are_the_wide_nodes_of_cartesian_trees():
    rng = np.random.default_rng(1)
    for trial in range(60):
        ends = np.cumsum(rng.integers(0, 60, 5))
        values = rng.integers(0, 9 if trial % 2 else 2 ** 38, ends[-1]).astype(np.uint64) << np.uint64(24)
        width, expected = int(rng.integers(1, 12)), set()

        def node(a, b):
            if b - a >= width:
                c = a + int(np.argmin(values[a:b]))
                expected.add((a, c, b - 1))
                node(a, c)
                node(c + 1, b)

        for a, b in zip([0, *ends[:-1]], ends):
            node(a, b)
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, ends, width)))) == expected


def repeat_corpus():
    rng = random.Random(31)
    shared = [prose(rng, n, 10_000).split() for n in (51, 60, 80, 200, 50)]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randrange(0, 300), 10_000).split()
        if i % 4 == 0:
            passage = list(shared[i // 4 % 5])
            if i % 8 == 0 and len(passage) > 59:
                passage[len(passage) // 2] = f"edit{i}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((i, " ".join(words), "a"))
    line = prose(rng, 12, 10_000)
    rows += [(200 + k, line + " " + prose(rng, 100, 10_000), "a") for k in range(30)]  # a short line that repeats is no passage
    return rows + [(300 + k, rows[0][1], "a") for k in range(5)] + [(400, None, "a"), (401, "", "a"), (None, rows[4][1], "a"), (402, "For " * 300, "a"), (403, "For " * 200, "a")]


def test_repeated_passages(spark, no_docs):
    rows = repeat_corpus()
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    words = {i: [w for w in map(strip_word, (t or "").split()) if w] for i, t, _ in rows if i is not None}
    runs, shingle = defaultdict(set), lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    for i, w in words.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k:k + 50])].add(i)
    exact = [v for v in runs.values() if len(v) > 1]
    assert set().union(*exact) <= {r.doc_id for r in got}
    group = {r.doc_id: r.group_id for r in got}
    assert all(len({group[i] for i in v}) == 1 for v in exact)
    for r in got:  # both sides of every row hold the passage
        size = r.end_word - r.first_word
        a = words[r.doc_id][r.first_word:r.end_word]
        b = words[r.match_doc_id][r.match_first_word:r.match_first_word + size]
        assert size >= 50 and len(a) == size and r.group_id <= r.doc_id != r.match_doc_id
        assert len(shingle(a) & shingle(b)) >= 0.7 * len(shingle(a) | shingle(b)), r
    assert not {r.doc_id for r in got} & set(range(200, 230))
    assert not any(r.doc_id % 4 for r in got if r.doc_id < 200)
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_near_passages_are_found(spark):
    """Recall against brute force: pairs of texts with one passage at a similarity of 0.8 or more."""
    rng = random.Random(77)
    rows, pairs = [], 0
    for k in range(60):
        base = prose(rng, 50, 10_000).split()
        other = list(base)
        other[rng.randrange(8, 42)] = "edited"
        rows += [(2 * k, " ".join(base), "a"), (2 * k + 1, " ".join(other), "a")]
        pairs += 1
    got = {r.doc_id // 2 for r in substring_dedup.repeated_passages(as_docs(spark, rows)).collect() if r.doc_id // 2 == r.match_doc_id // 2}
    assert len(got) >= 0.9 * pairs


def spans(rows, first, second):
    """(first_word, end_word, match_first_word, similarity) of a document's passages in another, by place."""
    return sorted((r.first_word, r.end_word, r.match_first_word, r.similarity) for r in rows if (r.doc_id, r.match_doc_id) == (first, second))


def test_passages_apart_at_one_shift_stay_apart(spark):
    rng = random.Random(5)
    head, foot = prose(rng, 70, 10_000), prose(rng, 60, 10_000)
    rows = [(i, f"{head} {prose(rng, 90, 10_000)} {foot}", "a") for i in range(2)]
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    assert spans(got, 0, 1) == spans(got, 1, 0)
    assert all(end <= 75 or first >= 155 for first, end, _, _ in spans(got, 0, 1))
    assert {first < 75 for first, _, _, _ in spans(got, 0, 1)} == {True, False}


def test_many_contents_of_one_signature(spark):
    """Variants of one passage, and a frequent line under fifty words that lies in a longer passage of a few."""
    rng, rows = random.Random(8), []
    around = lambda words: " ".join([prose(rng, 40, 10_000), *words, prose(rng, 40, 10_000)])
    for k in range(4):
        base = prose(rng, 52, 10_000).split()
        rows.append((100 * k, around(base), "a"))
        for own in range(1, 31):
            variant = list(base)
            variant[rng.randrange(52)] = f"edit{own}"
            rows.append((100 * k + own, around(variant), "a"))
    line = prose(rng, 40, 10_000).split()
    long = [prose(rng, 6, 10_000), *line, prose(rng, 6, 10_000)]
    rows += [(1000 + i, around(line), "a") for i in range(150)] + [(2000 + i, around(long), "a") for i in range(5)]
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    group = {r.doc_id: r.group_id for r in got}
    assert sum(group.get(i) == i // 100 * 100 for i, _, _ in rows if i < 1000) >= 112  # of 124
    assert [group.get(2000 + i) for i in range(5)] == [2000] * 5
    assert not [i for i in group if 1000 <= i < 2000]


def test_large_groups_are_cut_and_stay_connected(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELL", 4)
    rng = random.Random(9)
    passage = prose(rng, 80, 10_000)
    rows = [(i, f"{prose(rng, 40, 10_000)} {passage} {prose(rng, 40, 10_000)}", "a") for i in range(40)]
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(i, 0) for i in range(40)}


def test_short_passages_within_other_text(spark):
    """Passages of 50 to 60 words, equal and with one word edited, prose before and after them."""
    rng, rows, places = random.Random(10), [], {}
    for k in range(240):
        n, edited = 50 + k % 11, k >= 120
        base = prose(rng, n, 10_000).split()
        for own in range(2):
            words = list(base)
            if edited:
                words[n // 2] = f"edit{own}"
            places[2 * k + own] = (at := rng.randrange(30, 90), n)
            rows.append((2 * k + own, " ".join([prose(rng, at, 10_000), *words, prose(rng, 60, 10_000)]), "a"))
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    found = [spans(got, 2 * k, 2 * k + 1) for k in range(240)]
    for k in range(120):
        (at, n), (there, _) = places[2 * k], places[2 * k + 1]
        assert found[k] == [(at, at + n, there, 1.0)], k
    assert sum(map(bool, found[120:])) >= 108


def test_near_passages_besides_equal_ones(spark):
    rng = random.Random(6)
    rows, pairs = [], [rng.sample(range(10 ** 6), 2) for _ in range(60)]
    for pair in pairs:
        equal, near = prose(rng, 80, 10_000), prose(rng, 60, 10_000).split()
        for own, i in enumerate(pair):
            near[30] = f"edit{own}"
            rows.append((i, f"{equal} {prose(rng, 60 + own, 10_000)} {' '.join(near)}", "a"))
    rng.shuffle(rows)
    got = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    ours = [spans(got, *pair) for pair in pairs]
    assert all((0, 80, 0, 1.0) in found for found in ours)
    assert sum(any(first >= 135 and there == first + 1 for first, _, there, _ in found) for found in ours) >= 54


def test_windows_of_one_signature_keep_their_contents():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2 ** 60, 60)
    variant = passage.copy()
    variant[30] = 7
    codes = np.concatenate([passage, rng.integers(0, 2 ** 60, 60), variant, rng.integers(0, 2 ** 60, 60), passage])
    _, signature, place, content = substring_dedup.document_windows(codes, np.array([len(codes)]))
    first = place >> 16
    both = {s for s in signature if len(set(content[signature == s])) > 1}
    assert any((first[signature == s] < 70).any() and ((first[signature == s] > 100) & (first[signature == s] < 180)).any() for s in both)
    assert len(set(zip(signature, content))) == len(signature)  # what repeats counts once


def test_word_coder_sees_the_words():
    coder = WordCoder(lambda words: np.array([hash(w) & 0xFFFF for w in words], np.int64))
    texts = ["A b,\n(c) -- d\t\x0be", None, "", "--", " x  "]
    numbers, ends = coder.code(pa.array(texts))
    expected = [[w for w in map(strip_word, (t or "").split()) if w] for t in texts]
    assert ends.tolist() == np.cumsum([len(e) for e in expected]).tolist()
    assert numbers.tolist() == [hash(w) & 0xFFFF for e in expected for w in e]
