"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, modal, target, negation, reported speech, other. Five small
transducers read a clause's symbols side by side, composed into one product automaton:

* insult: emits the word's weight;
* threat: emits a threat verb's weight, more after a modal ("will kill");
* target: remembers whether the clause names somebody;
* negation: for three words after a negation, what is emitted counts as negated;
* reported speech: after a verb of saying, what is emitted counts as reported.

A clause ends at ``.``, ``!``, ``?``, ``;``, ``:``, a newline or the text's end. What the matched clauses
emitted, by kind, are a document's features, and a logistic curve makes them a score. Seed words come
with the grammar. Further insults are stems learned from labels: words or beginnings of words that
toxic documents use far more often than others. They and the curve are fitted on a bounded
sample of labelled rows (SAMPLE_ROWS); every text is scored, whole.
"""
from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back
from .pieces import MEMORY_BYTES, PIECE_BYTES, PIECE_LENGTH

#: About so many labelled rows are learned from, chosen by a hash of their id.
SAMPLE_ROWS = 16_000
#: A stem needs so many toxic documents of the sample, and such log odds against the others.
STEM_DOCS, STEM_ODDS = 5, 2.5
SEED_WEIGHT = 2.0
#: Texts are read in groups of about so many bytes.
GROUP_BYTES = 4 << 20
THRESHOLD = 0.7
_HASH_RANGE = 1_000_000

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORTED = range(7)

# The seed words of the grammar, in English, French, German and Spanish.
SEEDS = {
    INSULT: "idiot moron stupid worthless pathetic disgusting loser scum trash clown imbecile fool dumb jerk "
            "crétin débile connard salaud dummkopf trottel arschloch schwachkopf estúpido imbécil tonto basura",
    THREAT: "kill hurt beat shoot stab destroy tuer frapper töten schlagen matar golpear",
    MODAL: "will shall gonna going vais allons werde werden voy vamos",
    TARGET: "you your yourself he him she her they them people tu vous toi ils du dich dein ihr usted tú ellos vosotros",
    NEGATION: "not never no neither nor isn't aren't wasn't don't doesn't didn't ne jamais nicht kein keine nie nunca tampoco",
    REPORTED: "said says called calls wrote claims claimed quoted reported dit disait écrit sagte sagt schrieb dijo dice escribió",
}
KINDS = ("asserted", "targeted", "negated", "reported", "threat")
# White space but the blank and the newline: it parts words as a blank does.
_SPACE = r"[\t\x{0B}\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_END = re.compile(r"[.!?;:]$")
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PREFIXES = range(3, 9)


def _product() -> dict:
    """(state, symbol) -> (state, kind that an emission has, factor); a state is (negation, reported, target, modal)."""
    table = {}
    for state in itertools.product(range(4), range(2), range(2), range(3)):
        negation, reported, target, modal = state
        for symbol in range(7):
            after = (3 if symbol == NEGATION else max(0, negation - 1), int(reported or symbol == REPORTED),
                     int(target or symbol == TARGET), 2 if symbol == MODAL else max(0, modal - 1))
            emission = None
            if symbol in (INSULT, THREAT):
                kind = 3 if reported else 2 if negation else 4 if symbol == THREAT else 0
                emission = (kind, 2.0 if symbol == THREAT and modal else 1.0)
            table[state, symbol] = after, emission
    return table


_TABLE = _product()
_PLAIN = ((OTHER, 0.0, False), (OTHER, 0.0, True))


def read_clause(symbols: list[int], weights: list[float]) -> np.ndarray:
    """What a clause emits, by kind. An insult asserted in a clause with a target is ``targeted``."""
    state, out = (0, 0, 0, 0), np.zeros(len(KINDS))
    for symbol, weight in zip(symbols, weights):
        state, emission = _TABLE[state, symbol]
        if emission:
            out[emission[0]] += emission[1] * weight
    if state[2]:
        out[1], out[0] = out[0], 0.0
    return out


@dataclass
class Grammar:
    """Lexicon and curve. ``stems`` maps a beginning of a word, or ``word$``, to its weight."""
    stems: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, *[1.0] * len(KINDS), 1.0]))

    def __post_init__(self):
        self.seeds = {w: (symbol, SEED_WEIGHT) for symbol, words in SEEDS.items() for w in words.split()}
        self.known: dict[str, tuple[int, float, bool]] = {}
        self.size = 0

    def look_up(self, piece: str) -> tuple[int, float, bool]:
        """(symbol, weight, whether a clause ends here) of a piece of text between blanks."""
        found = self.known.get(piece)
        if found is None:
            symbol, weight = OTHER, 0.0
            for word in _LETTERS.findall(piece.lower()):
                best = max([self.stems.get(word + "$", 0.0), *(self.stems.get(word[:k], 0.0) for k in PREFIXES)])
                seed = self.seeds.get(word, (OTHER, 0.0))
                if best > 0:
                    symbol, weight = INSULT, max(best, weight)
                elif seed[0] != OTHER and symbol == OTHER:
                    symbol, weight = seed
            ends = piece == "\n" or bool(_END.search(piece))
            # Most pieces say nothing: they share two entries.
            found = (symbol, weight, ends) if symbol != OTHER else _PLAIN[ends]
            if len(piece) <= PIECE_LENGTH:
                self.size += len(piece) + PIECE_BYTES
                if self.size > MEMORY_BYTES:
                    self.known.clear()
                    self.size = len(piece) + PIECE_BYTES
                self.known[piece] = found
        return found

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row per text: a constant, log(1 + emissions) by kind, and all emissions a hundred words."""
        texts = texts.fill_null("").cast(pa.large_string())
        if pc.any(pc.match_substring_regex(texts, _SPACE)).as_py():
            texts = pc.replace_substring_regex(texts, _SPACE, " ")
        texts = pc.replace_substring(texts, "\n", " \n ")
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        entries = [self.look_up(p) for p in coded.dictionary.to_pylist()]
        symbol = np.array([e[0] for e in entries], np.int8)[codes] if entries else np.empty(0, np.int8)
        weight = np.array([e[1] for e in entries])[codes] if entries else np.empty(0)
        ends = np.array([e[2] for e in entries], bool)[codes] if entries else np.empty(0, bool)
        sums = np.zeros((len(texts), len(KINDS)))
        if len(codes):
            last = np.zeros(len(codes), bool)
            last[bounds[1:] - 1] = True  # split gives every text a piece at least
            clause = np.concatenate([[0], np.cumsum(ends | last)[:-1]])
            starts = np.flatnonzero(np.diff(clause, prepend=-1))
            stops = np.append(starts[1:], len(codes))
            for c in np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]):
                a, b = starts[c], stops[c]
                text = np.searchsorted(bounds, a, side="right") - 1
                sums[text] += read_clause(symbol[a:b].tolist(), weight[a:b].tolist())
        words = np.maximum(np.diff(bounds), 1)
        density = np.log1p(100 * sums.sum(axis=1) / words)
        return np.column_stack([np.ones(len(texts)), np.log1p(sums), density])

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    at = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * at)
        at = at + step
        if np.abs(step).max() < 1e-6:
            break
    return at


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the features that tell: of beginnings that cover the same documents the longest."""
    odds = {f: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) for f, (t, c) in counts.items()}
    longer: Counter = Counter()  # the most documents of any feature that is one sign longer
    for g, (t, _) in counts.items():
        longer[g[:-1]] = max(longer[g[:-1]], t)
    chosen: dict[str, float] = {}
    for f in sorted((f for f in counts if odds[f] >= STEM_ODDS and counts[f][0] >= STEM_DOCS), key=lambda f: (len(f), f)):
        word = f.rstrip("$")
        if any(word[:k] in chosen for k in PREFIXES):
            continue  # a shorter beginning stands for it
        if f.endswith("$") or longer[f] < 0.95 * counts[f][0]:
            chosen[f] = min(odds[f], 6.0)
    return chosen


def word_features(text: str) -> set[str]:
    """Words, marked by ``$``, and beginnings of words."""
    found = set()
    for word in set(_LETTERS.findall(text.lower())):
        found.add(word + "$")
        found.update(word[:k] for k in PREFIXES if len(word) >= k)
    return found


def learnable(id_col: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text mod 3 is not 1."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) != 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar fitted to labelled rows. Without toxic and other rows the seeds decide alone.

    Null ids, labels and texts are left out; the labels of an id that has several count each.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & learnable(F.col("id")))
    h = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(_HASH_RANGE))
    cut = int(_HASH_RANGE * min(1.0, SAMPLE_ROWS / max(1, usable.count())))
    # The bound of the broadcast: the hash takes about SAMPLE_ROWS, the limit twice that at most.
    sample = usable.withColumn("h", h).filter(F.col("h") < cut).orderBy("h", "id", "label").limit(2 * SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").join(
        F.broadcast(sample), "id")
    rows = rows.select("text", "label", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter() for _ in range(4)]
            for text, label, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found[2 * half + label].update(word_features(text.as_py()))
                found[2 * half + label][""] += 1
            features = list(set().union(*found))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), *(
                pa.array([c[f] for f in features], pa.int64()) for c in found)], ["feature", *names])

    names = ["clean0", "toxic0", "clean1", "toxic1"]
    counts = (rows.mapInArrow(count, "feature string, " + ", ".join(f"{n} bigint" for n in names))
              .groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
              .filter(F.col("toxic0") + F.col("toxic1") >= STEM_DOCS))
    # At most SAMPLE_ROWS * (features a document) / STEM_DOCS rows, however large the corpus is.
    table = {f: np.array(n).reshape(2, 2) for f, *n in counts.collect()}  # by half and label
    if "" not in table or not table[""].all():
        return Grammar()

    def stems(halves: slice) -> dict[str, float]:
        summed = {f: tuple(n[halves].sum(axis=0)[::-1].tolist()) for f, n in table.items()}
        toxic, clean = summed.pop("")
        return choose_stems(summed, toxic, clean)

    # Each half is read with the stems of the other, so that the curve is not fitted to stems learned by heart.
    other = [Grammar(stems(slice(1, 2))), Grammar(stems(slice(0, 1)))]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, grammar in enumerate(other):
                part = batch.filter(pc.equal(batch.column(2), half))
                if part.num_rows:
                    x = grammar.features(part.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], ["x", "label"])

    fitted = rows.mapInArrow(featured, "x array<double>, label int").collect()
    return Grammar(stems(slice(0, 2)), fit_curve(np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted])))


def score_texts(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "score",
                predicted_col: str = "predicted") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1) and predicted (1 if the score is THRESHOLD or more).

    Null and empty texts match no clause and get the curve's lowest end. Columns that have the names of
    the two new ones are replaced; the others stay.
    """
    from pyspark.sql import types as T
    kept = docs.drop(score_col, predicted_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    at = kept.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(batch, at, GROUP_BYTES):
                score = grammar.score(rows.column(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                                 names=schema.names)
        grammar.known.clear()
        give_back()

    return kept.mapInArrow(judge, schema)
