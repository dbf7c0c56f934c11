"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items are the index's documents and every passage of every training text is a query. A score is
BM25 of the item for the passage's distinct words, as a share of what the item could reach, so one
threshold fits items of any length. Items lie in blocks, and each term keeps its greatest weight in
each block. For a passage the sum of its terms' block maxima bounds the score of all items of a
block: blocks below the threshold are skipped whole, the others scored exactly, so everything above
the threshold is retrieved. The passages of a batch go through the index together: bounds, skips
and scores are sums over term lists in NumPy.

An item retrieved for a passage is a leak if the five-word shingles of its question and those of its
answer are found around the passage, at least OVERLAP of each. Question: the item without its last
sentence; answer: the last sentence, but at least its last five words, and what is left of an
item of one sentence is its question. One edit spoils most shingles of an answer of under SHORT words: such an
answer also counts as found if OVERLAP of its words are there.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back
from .pieces import WordCoder, strip_word

K1, B = 1.2, 0.75
#: Share of an item's greatest possible score that a passage must reach to be looked at.
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
#: Answers of fewer words are compared by their words where their shingles differ.
SHORT = 10
#: Passages are TILE * 2 words and start every TILE words; longer items are indexed in units of TILE words.
TILE = 64
#: Items a block.
BLOCK = 8
#: Test items are indexed in slices of about so many words, a pass over the texts for each.
SLICE_WORDS = 2_000_000
#: (passage, block) sums held at a time.
CELLS = 50_000
#: Texts are searched in groups of about so many bytes.
GROUP_BYTES = 1 << 20


def words_of(text: str | None) -> list[str]:
    return [w for w in map(strip_word, (text or "").split()) if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of both parts."""
    words = words_of(text)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if words_of(s)]
    tail = max(len(words_of(sentences[-1])) if len(sentences) > 1 else 0, min(SHINGLE, len(words)))
    return words[:len(words) - tail], words[len(words) - tail:]


def shingles(words: list) -> set[tuple]:
    """Runs of five words; of fewer words the whole; of none nothing."""
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class BlockMaxIndex:
    """Postings with block maxima. ``items`` are (id, text); ``df``, ``n``, ``mean`` describe all items."""

    def __init__(self, items: list[tuple], df: dict[str, int], n: int, mean: float):
        self.items, self.parts = items, []
        self.terms: dict[str, int] = {}
        vectors, owners = [], []
        for at, (_, text) in enumerate(items):
            question, answer = question_and_answer(text)
            words = question + answer
            codes = [self.terms.setdefault(w, len(self.terms)) for w in words]
            asked, said = codes[:len(question)], codes[len(question):]
            self.parts.append((shingles(asked), shingles(said), said if SHINGLE <= len(said) < SHORT else None, len(words)))
            for begin in range(0, len(words), TILE):
                begin = max(0, min(begin, len(words) - TILE))  # the last unit is as long as the others
                unit = words[begin:begin + TILE]
                norm = K1 * (1 - B + B * len(unit) / mean)
                weights = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm)
                           for w, f in Counter(unit).items()}
                total = sum(weights.values())
                vectors.append({self.terms[w]: x / total for w, x in weights.items()})
                owners.append(at)
        # Units with the same common words come to lie in the same block, which makes its bounds tight.
        common = {t: df[w] for w, t in self.terms.items()}
        key = [sorted(v, key=lambda t: (-common[t], t))[:4] + [len(v)] for v in vectors]
        order = sorted(range(len(vectors)), key=lambda u: key[u])
        self.owner = np.array([owners[u] for u in order], np.int64)
        self.blocks = -(-len(order) // BLOCK)
        postings, maxima = defaultdict(list), defaultdict(dict)
        for place, u in enumerate(order):
            for t, x in vectors[u].items():
                postings[t].append((place, x))
                maxima[t][place // BLOCK] = max(x, maxima[t].get(place // BLOCK, 0.0))
        self.postings = _Lists([postings[t] for t in range(len(self.terms))])
        self.maxima = _Lists([sorted(maxima[t].items()) for t in range(len(self.terms))])

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, unit, score) of all scores of THRESHOLD or more, given distinct (passage, term) pairs by
        passage; passages are 0..n-1."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, CELLS // max(1, self.blocks))
        for begin in range(0, n, step):
            a, b = np.searchsorted(passage, [begin, begin + step])
            own, terms = passage[a:b] - begin, term[a:b]
            at, block, most = self.maxima.expand(terms)
            bound = np.bincount(own[at] * self.blocks + block, most, min(step, n - begin) * self.blocks)
            near = bound >= THRESHOLD - 1e-9
            if not near.any():
                continue
            # Only the blocks that a passage may reach are scored.
            at, unit, weight = self.postings.expand(terms[(open_ := near.reshape(-1, self.blocks).any(axis=1)[own])])
            owner = own[open_][at]
            keep = near[owner * self.blocks + unit // BLOCK]
            cells, place = np.unique(owner[keep] * len(self.owner) + unit[keep], return_inverse=True)
            score = np.bincount(place, weight[keep], len(cells))
            good = score >= THRESHOLD
            found.append((cells[good] // len(self.owner) + begin, cells[good] % len(self.owner), score[good]))
        return tuple(np.concatenate(x) for x in zip(*found))


class _Lists:
    """Lists of (place, weight) by term, end to end."""

    def __init__(self, lists: list[list[tuple[int, float]]]):
        self.ends = np.cumsum([len(x) for x in lists]) if lists else np.empty(0, np.int64)
        self.place = np.array([p for x in lists for p, _ in x], np.int64)
        self.weight = np.array([w for x in lists for _, w in x])

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into terms, place, weight) of all entries of the terms' lists."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        starts = np.concatenate([[0], self.ends[:-1]])[terms]
        sizes = self.ends[terms] - starts
        at = np.repeat(np.arange(len(terms)), sizes)
        flat = np.arange(len(at)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return at, self.place[flat], self.weight[flat]


def passages(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of passages of up to two tiles, one starting at each tile but a last short one."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    many = np.where(sizes > 0, np.maximum(1, -(-sizes // TILE) - 1), 0)
    text = np.repeat(np.arange(len(ends)), many)
    first = starts[text] + TILE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return text, first, np.minimum(first + 2 * TILE, ends[text])


def search(index: BlockMaxIndex, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """(text, item, score, first word, end, question overlap, answer overlap) of the verified leaks of a batch,
    the best passage of each pair; word numbers are within the text."""
    text, first, stop = passages(ends)
    sizes = stop - first
    passage = np.repeat(np.arange(len(text)), sizes)
    word = np.arange(len(passage)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    known = codes[word] >= 0
    pairs = np.unique(passage[known] * (len(index.terms) + 1) + codes[word[known]])
    which, unit, score = index.retrieve(pairs // (len(index.terms) + 1), pairs % (len(index.terms) + 1), len(text))
    best: dict[tuple[int, int], tuple] = {}
    starts = np.concatenate([[0], ends[:-1]])
    known_there: dict[tuple[int, int], set] = {}  # the shingles of a stretch of words, once for all items found near it
    for p, u, s in zip(which.tolist(), unit.tolist(), score.tolist()):
        item, t = int(index.owner[u]), int(text[p])
        question, answer, short, size = index.parts[item]
        # The item may go on beyond the passage on either side.
        a, b = max(starts[t], first[p] - size), min(ends[t], stop[p] + size)
        if (a, b) not in known_there:
            known_there[a, b] = shingles(codes[a:b].tolist())
        there = known_there[a, b]
        if size < SHINGLE:
            there = there | {tuple(codes[i:i + size].tolist()) for i in range(a, b - size + 1)}
        shares = [len(part & there) / len(part) if part and len(next(iter(part))) == SHINGLE else
                  float(_contains(part, codes[a:b])) for part in (question, answer)]
        if short is not None:  # one edit spoils most of its shingles: its words count
            words = set(codes[a:b].tolist())
            shares[1] = max(shares[1], sum(w in words for w in short) / len(short))
        if min(shares) >= OVERLAP and s > best.get((t, item), (0.0,))[0]:
            best[t, item] = (s, int(first[p] - starts[t]), int(stop[p] - starts[t]), *shares)
    for (t, item), rest in best.items():
        yield t, item, *rest


def _contains(part: set[tuple], codes: np.ndarray) -> bool:
    """Whether a part of fewer than five words (or none) is there as a whole."""
    return all(any(tuple(codes[i:i + len(p)].tolist()) == p for i in range(len(codes) - len(p) + 1)) for p in part)


def indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[BlockMaxIndex]:
    """Indexes of slices of bounded size that together hold all items; statistics are of all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words_of(t) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["words"])

    cut_up = rows.select("text").mapInArrow(cut, "words array<string>").filter(F.size("words") > 0)
    n, total = cut_up.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    slices = -(-(total or 0) // SLICE_WORDS)
    df = cut_up.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for k in range(slices):
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k)
        held = sorted({(r["id"], r["text"]) for r in own.collect() if words_of(r["text"])}, key=lambda r: (r[0] is None, r))
        vocabulary = own.select("text").mapInArrow(cut, "words array<string>").select(F.explode("words").alias("word")).distinct()
        counts = df if slices == 1 else df.join(vocabulary, "word", "left_semi")
        yield BlockMaxIndex(held, dict(counts.collect()), n, total / n)


def _coder(index: BlockMaxIndex) -> WordCoder:
    return WordCoder(lambda words: np.fromiter((index.terms.get(w, -1) for w in words), np.int64, len(words)))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, end_word, question_overlap, answer_overlap): a row per row of ``docs``
    and test item that it contains; clean texts have none.

    Texts and items that are null or have no word match nothing. Items equal in id and text are one.
    Rows that repeat an id are searched each. Other columns are not read. Without items the result
    is empty. Texts are read whole, in passages that overlap by half.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(slim.dtypes)["id"], dict(items.dtypes)[item_id]
    schema = (f"{id_col} {kinds[0]}, {item_id} {kinds[1]}, score double, first_word bigint, end_word bigint, "
              "question_overlap double, answer_overlap double")
    found = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item_id, item_text):
        def look(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            coder = _coder(index)
            for batch in batches:
                for rows in by_bytes(batch, 1, GROUP_BYTES):
                    hits = list(search(index, *coder.code(rows.column(1))))
                    ids = rows.column(0)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([index.items[h[1]][0] for h in hits], pa.int64() if kinds[1] == "bigint" else None),
                        *(pa.array([h[i] for h in hits], t) for i, t in enumerate(
                            [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], 2))],
                        [id_col, item_id, "score", "first_word", "end_word", "question_overlap", "answer_overlap"])

        found = found.union(slim.mapInArrow(look, schema))
    return found


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that contain no test item."""
    for index in indexes(items, item_id, item_text):
        at = docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            coder = _coder(index)
            for batch in batches:
                for rows in by_bytes(batch, at, GROUP_BYTES):
                    leaky = {h[0] for h in search(index, *coder.code(rows.column(at)))}
                    yield rows.filter(pa.array([i not in leaky for i in range(rows.num_rows)], pa.bool_()))
            del coder
            give_back()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
