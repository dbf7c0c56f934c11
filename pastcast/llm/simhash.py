"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits: the majority of the XXH64 values of its word shingles. Two
fingerprints link if they differ in at most t bits. The bits are cut into t + 1 segments on a ring.
If two fingerprints differ in at most t bits, then from some segment on, every chain of l
consecutive segments differs in at most l * t / (t + 1) bits, rounded down: l - 1. So the first
segment of that chain is equal, and of the two halves of the next, which may differ in one bit, one
is equal too: those bits are the join key. Pairs with a common key are checked along the chain,
segment by segment, and only those that stay within every budget reach the full Hamming check.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: Fingerprints with one key are compared within cells of at most about twice so many.
CELL = 2048
#: Groups up to SMALL rows are compared all at once by distance; larger ones in strips of STRIP rows.
SMALL, STRIP = 32, 64
#: Words hashed at a time; bounds the memory a long text takes.
WORDS_AT_ONCE = 1 << 16

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[_SPACES] = 0x20


def word_bounds(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with A-Z lower-cased and one space between words; where its words start and end."""
    folded = _FOLD[np.frombuffer(text, np.uint8)]
    inside = folded != 0x20
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    joined = folded[keep]
    if len(joined) and joined[-1] == 0x20:
        joined = joined[:-1]
    if not len(joined):
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(joined == 0x20)
    return joined.tobytes(), np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is set if set in over half of the shingles' hashes, repeats
    included. Fewer words than a shingle: the hash of them all; no word: zero."""
    joined, starts, ends = word_bounds(text)
    if not len(starts):
        return 0
    first, last = starts[:max(1, len(starts) - shingle + 1)], ends[min(shingle, len(ends)) - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), WORDS_AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(
            first[at:at + WORDS_AT_ONCE].tolist(), last[at:at + WORDS_AT_ONCE].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """(id, content, fingerprint) of every row; a null text has no words. content is a hash of the text."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("content"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [fingerprint(t.as_py() or b"", shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.int64())],
                                             ["id", "content", "fingerprint"])

    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(hashed, f"id {kind}, content bigint, fingerprint bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the max_bits + 1 segments."""
    edges = np.linspace(0, 64, max_bits + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, max_bits: int) -> Column:
    """An array with, for each segment, two keys: its bits and either half of the next segment's."""
    ring, keys = segments(max_bits), []
    for i, (first, bits) in enumerate(ring):
        after, more = ring[(i + 1) % len(ring)]
        halves = [(after, more // 2), (after + more // 2, more - more // 2)] if len(ring) > 1 else [(first, bits)]
        for h, half in enumerate(halves):
            mask = _signed(_mask(first, bits) | _mask(*half))
            keys.append(F.struct(F.lit(i).alias("segment"),
                                 F.xxhash64(F.lit(i), F.lit(h), fp.bitwiseAND(F.lit(mask))).alias("key")))
    return F.array(*keys)


class _Links:
    """Rows joined by checked pairs; ``root`` is each row's first row."""

    def __init__(self, segment: np.ndarray, fp: np.ndarray, max_bits: int):
        self.segment, self.fp, self.max_bits = segment, fp, max_bits
        self.root = np.arange(len(fp))
        ring = segments(max_bits)
        self.chains = np.zeros((len(ring), len(ring)), np.uint64)  # by first segment and chain length
        for i in range(len(ring)):
            mask = 0
            for length in range(len(ring)):
                mask |= _mask(*ring[(i + length) % len(ring)])
                self.chains[i, length] = mask

    def check(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs that stay within the budget of every chain from their segment on."""
        differ = self.fp[a] ^ self.fp[b]
        for length in range(1, self.max_bits + 1):  # the chain's budget is a bit less than its length
            fits = np.bitwise_count(differ & self.chains[self.segment[a], length - 1]) <= length - 1
            a, b, differ = a[fits], b[fits], differ[fits]
        good = np.bitwise_count(differ) <= self.max_bits
        self.join(a[good], b[good])

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            left, right = root[a], root[b]
            apart = left != right
            if not apart.any():
                return
            a, b, left, right = a[apart], b[apart], left[apart], right[apart]
            np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
            low, high = min(a.min(), b.min(), left.min(), right.min()), len(root)
            while True:
                jumped = root[root[low:high]]
                if (jumped == root[low:high]).all():
                    break
                root[low:high] = jumped


def link_rows(group: np.ndarray, segment: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row the first row it is connected to by links within its group (rows sorted by group).

    Pairs that are connected already are not looked at again.
    """
    links, n = _Links(segment, fp, max_bits), len(fp)
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL):  # all small groups together, by distance
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        links.check(at, at + step)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = _Links(segment[start:start + size], fp[start:start + size], max_bits)
        for row in range(0, size, STRIP):
            strip = own.root[row:row + STRIP]
            a, b = np.nonzero(strip[:, None] != own.root[None, row:])
            ahead = b > a
            own.check(a[ahead] + row, b[ahead] + row)
        links.root[start:start + size] = own.root + start
    return links.root


def link_fingerprints(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect whatever links of at most ``max_bits`` bits connect.

    ``distinct`` has one row per ``fingerprint``. Within a key a spanning forest comes out, never
    all pairs. A key with more than CELL rows is cut into blocks; every pair of blocks is a cell.
    """
    keyed = distinct.select("fingerprint", F.inline(_keys(F.col("fingerprint"), max_bits)))
    blocks = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
              .select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64(F.lit("block"), "fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    celled = (keyed.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("block", block).withColumn("other", other)
              .select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell"),
                      "segment", "fingerprint"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)]

        def edges(key, cell, segment, fp):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            root = link_rows(np.cumsum(new), segment, fp, max_bits)
            moved = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.unique(np.stack([fp[moved], fp[root[moved]]]).view(np.int64), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy().astype(h.dtype if i < 3 else np.int64).view(h.dtype)])
                    for i, h in enumerate(held)]
            if not len(rows[0]):
                continue
            # The last group may go on in the next batch.
            last = len(rows[0]) - np.argmax(((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[::-1])
            if last == len(rows[0]) and (rows[0] == rows[0][-1]).all() and (rows[1] == rows[1][-1]).all():
                last = 0
            held = [r[last:] for r in rows]
            if last:
                yield edges(*(r[:last] for r in rows))
        if len(held[0]):
            yield edges(*held)

    dealt = celled.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(link, "u bigint, v bigint").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int) -> DataFrame:
    """(id, content, fingerprint, component, component_id); component is a fingerprint, never null."""
    printed = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = materialise(printed.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "distinct")
    stars = connected_components(link_fingerprints(distinct, max_bits))  # node, component
    rooted = distinct.join(stars, distinct["fingerprint"] == stars["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return printed.join(rooted.join(smallest, "component").select("fingerprint", "component", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint as a signed long, component_id) of every row of ``docs``.

    component_id is the smallest id that links reach, the row's own included. Texts that are null,
    empty or blank have fingerprint zero, which links like any other. Equal texts share a
    fingerprint and are handled once. Null ids get rows and count for no minimum. Rows that repeat
    an id keep a row each. Other columns are not read. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, shingle, max_bits, seed).select(
        F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row of ``docs``, all columns, of each group of linked texts: the one with the smallest id, null
    ids last; of rows that share it the one with the smallest hash of its text; of equal rows any."""
    rows = materialise(_grouped(docs, id_col, text_col, shingle, max_bits, seed).groupBy("component").agg(
        F.min_by(F.struct("id", "content"), F.struct(F.col("id").isNull(), "id", "content")).alias("best"))
        .select(F.col("best.id").alias("__id"), F.col("best.content").alias("__content")), "kept")
    content = F.xxhash64(F.col(text_col).cast("string"))
    kept = docs.join(rows, F.col(id_col).eqNullSafe(F.col("__id")) & (content == F.col("__content")))
    if docs.select(id_col, content.alias("__content")).groupBy(id_col, "__content").count().filter("count > 1").head(1):
        kept = kept.dropDuplicates(["__id", "__content"])
    return kept.select(*[docs[c] for c in docs.columns])
