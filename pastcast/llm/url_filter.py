"""URL filter: all glob rules as one bit-parallel automaton.

Each rule's symbols take one bit each in a row of 64-bit words, after a start bit of its own. One
step per byte of the canonical URL moves every rule at once (Shift-And):

    state = ((state << 1) & accepts[byte]) | (state & stays[byte])

``accepts[byte]`` has the bits whose symbol fits the byte, ``stays[byte]`` those that a ``*``
follows. The shift carries from word to word; a bit carried out of one rule lands on the next
one's start bit, which no byte accepts. A rule fits if its last bit is set at the end.

Globs: ``*`` any run of bytes, ``?`` one byte, anything else itself. The canonical URL is
``.`` + host + SPLIT + path, where SPLIT is a byte that no UTF-8 text has; neither ``*`` nor ``?``
crosses it, so that ``*.org`` + SPLIT + ``/*`` means the host org and its subdomains, any path.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = b"\xff"
#: URLs are stepped through in blocks of at most so many bytes, padding included, unless one is longer.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``name`` and ``kind`` are reported; ``verdict`` is allow or block; the highest rank that fits wins."""
    name: str
    kind: str
    verdict: str
    host_glob: str
    path_glob: str
    rank: int


def domain_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule wins."""
    return Rule(host + path, "domain", verdict, f"*.{host}", f"{path}*", 1_000_000 + len(host + path))


def glob_rule(host_glob: str, path_glob: str = "*", verdict: str = "block") -> Rule:
    """Fits the whole host (written with a leading dot) and path; ranks below every domain rule."""
    return Rule(f"{host_glob} {path_glob}", "glob", verdict, host_glob, path_glob, len(host_glob + path_glob))


class Automaton:
    """Bit masks of a list of rules, and the simulation over many URLs."""

    def __init__(self, rules: Iterable[Rule]):
        # Rules in falling rank: the first that fits is the winner.
        self.rules = sorted(rules, key=lambda r: (-r.rank, r.name))
        bit, symbols, starts, finals, loops = 0, [], [], [], []
        for rule in self.rules:
            starts.append(bit)
            for c in rule.host_glob.encode() + SPLIT + rule.path_glob.encode():
                if c == ord("*"):
                    loops.append(bit)
                else:
                    bit += 1
                    symbols.append((bit, c))
            finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.finals = np.array(finals, dtype=np.int64)
        self.start = np.zeros(self.words, np.uint64)
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        for at in starts:
            self.start[at >> 6] |= np.uint64(1 << (at & 63))
        inner = np.arange(256) != SPLIT[0]
        for at, c in symbols:
            fits = inner if c == ord("?") else np.arange(256) == c
            self.accepts[fits, at >> 6] |= np.uint64(1 << (at & 63))
        for at in loops:
            self.stays[inner, at >> 6] |= np.uint64(1 << (at & 63))

    def run(self, urls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final states; ``urls`` is bytes (url, position), sorted by falling length."""
        state = np.broadcast_to(self.start, (len(lengths), self.words)).copy()
        alive = np.searchsorted(-lengths, -np.arange(urls.shape[1]), side="left")
        for at in range(urls.shape[1]):
            n = alive[at]  # the rows that are longer than ``at``
            byte, now = urls[:n, at], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.accepts[byte]) | (now & self.stays[byte])
        return state

    def winners(self, urls: list[bytes]) -> np.ndarray:
        """Per URL the place in ``self.rules`` of the winner, or -1."""
        out = np.full(len(urls), -1, np.int64)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        done = 0
        while done < len(urls) and self.rules:
            width = max(1, lengths[order[done]])
            rows = order[done:done + max(1, BLOCK_BYTES // width)]
            data = np.zeros((len(rows), width), np.uint8)
            for i, r in enumerate(rows):
                data[i, :lengths[r]] = np.frombuffer(urls[r], np.uint8)
            state = self.run(data, lengths[rows])
            best = np.full(len(rows), -1, np.int64)
            for k in range(len(self.rules) - 1, -1, -1):
                at = self.finals[k]
                best[(state[:, at >> 6] >> np.uint64(at & 63)) & np.uint64(1) == 1] = k
            out[rows] = best
            done += len(rows)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there up to ``?``, ``#`` or the end. Both empty for a null or a URL without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def filter_urls(df: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_kind (null if none fits) and verdict to every row of ``df``.

    Null, empty and malformed URLs have an empty host and path, which rules fit or not like any
    other. Of rules with the same rank the first by name wins. Repeated rows stay. The five columns
    replace columns of the same names.
    """
    rules = list(rules)
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    parsed = df.withColumns({"host": host, "path": path}).drop("rule", "rule_kind", "verdict")
    schema = T.StructType([*parsed.schema.fields, *(
        T.StructField(c, T.StringType()) for c in ("rule", "rule_kind", "verdict"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        names = pa.array([r.name for r in automaton.rules], pa.string())
        kinds = pa.array([r.kind for r in automaton.rules], pa.string())
        verdicts = pa.array([r.verdict for r in automaton.rules], pa.string())
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("host", "path"))
            won = automaton.winners([b"." + h.encode() + SPLIT + p.encode() for h, p in zip(hosts, paths)])
            taken = pa.array(won, mask=won < 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, names.take(taken), kinds.take(taken), verdicts.take(taken).fill_null(default)],
                names=schema.names)

    return parsed.mapInArrow(judge, schema)


#: The rules the query is to apply.
DOMAIN_RULES = [domain_rule("org", "/", "allow"), domain_rule("example.org", "/es/", "block"),
                domain_rule("example.org", "/en/1", "block"), domain_rule("com", "/fr/", "allow"),
                domain_rule("com", "/de/", "block")]
#: Kinds of hosts that a training corpus commonly leaves out; they decide where no domain rule does.
GLOB_RULES = [glob_rule(f"*{word}*") for word in (
    "casino", "poker", "free-bets", "cheap-pills", "viagra", "ads-track", "doubleclick", "adserver", "xxx")]
