"""Token ids of whole texts with a public byte-level BPE, in Arrow batches.

Such a tokenizer cuts text into words before merging bytes, and a blank always starts a word when
the characters on both sides are not white space. So a text can be cut at those blanks, the pieces
encoded once each by the library, and their ids put together: the same ids as for the whole text,
which the tests hold against whole-text encoding. Texts are big and pieces repeat, so most of the
work is Arrow's split and dictionary encoding and NumPy's gather.

A text that holds an added token's string (``<|endoftext|>``) goes to the library whole, which finds it there.
The memory of pieces is bounded in bytes, and long pieces (text without blanks) are never kept.
"""
from __future__ import annotations

import itertools
import operator
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the pieces remembered in a worker; when it would be more, KEPT_BYTES of them stay.
MEMORY_BYTES = 96 << 20
#: What a worker keeps of them from task to task: the next task, of any stage, needs the room. The first ones
#: that it met stay: frequent words come early.
KEPT_BYTES = 48 << 20
#: What a piece takes beside its characters (a string, an entry, a number), and how long it may be to be remembered.
PIECE_BYTES, PIECE_LENGTH = 150, 64
#: Pieces joined for the library, and joined strings of one call.
JOINED, CALL = 1000, 32
#: Texts are encoded in groups of about so many bytes, or one by one if longer.
GROUP_BYTES = 4 << 20

# A blank with white space before it, and white space or the end after it, is inside a run whose
# cut depends on more than its neighbours. The classes hold all that any library calls white space.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\pZ]"
_RUNS = f"{_SPACE} (?:{_SPACE}|$)"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    """The file of the 50,257-id byte-level BPE on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _strings(texts: pa.Array) -> list[str]:
    """A string array without nulls as Python's strings, made by Arrow in one go rather than one scalar each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``encode`` gives flat ids and where each text's ids end; made once per Python worker."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # Bytes that each id stands for; the vocabulary writes each byte as one character.
        self.byte_lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.byte_lengths[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        # Slots by piece: of those that start with a blank without it, and of the others.
        self.slots: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.size = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of slot i: ends[i] up to ends[i + 1]

    def _trim(self) -> None:
        """Only the pieces met first stay, of KEPT_BYTES."""
        n = int((len(self.slots) + len(self.firsts)) * KEPT_BYTES / self.size)
        self.slots = {p: i for p, i in self.slots.items() if i < n}
        self.firsts = {p: i for p, i in self.firsts.items() if i < n}
        self.size = sum(PIECE_BYTES * len(t) + sum(map(len, t)) for t in (self.slots, self.firsts))
        self.ids, self.ends = self.ids[:max(1, int(self.ends[n]))].copy(), self.ends[:n + 1].copy()

    def rest(self) -> None:
        """The end of a task: more than KEPT_BYTES are not kept for the next one."""
        while self.size > KEPT_BYTES:
            self._trim()

    def _learn(self, words: list[str], firsts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of new pieces, which it encodes: a blank and a word, and pieces as they are.

        Words without white space at their ends can be joined, for one call in place of many."""
        joins = np.fromiter(map(operator.eq, map(str.strip, words), words), bool, len(words)) & np.fromiter(map(bool, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        plain = words if joins.all() else list(itertools.compress(words, joins))
        other = [" " + words[i] for i in order[len(plain):]] + firsts
        texts = [" " + " ".join(plain[i:i + JOINED]) for i in range(0, len(plain), JOINED)] + other
        got = [np.empty(0, np.uint32)]
        for i in range(0, len(texts), CALL):  # the library's results are many times the ids; the fast ones have no offsets
            got += [np.array(g.ids, np.uint32) for g in self.tokenizer.encode_batch_fast(texts[i:i + CALL], add_special_tokens=False)]
        ids = np.concatenate(got)
        # Each id stands for a known number of bytes, so a joined piece ends at the id that ends with it.
        id_ends = np.concatenate([[0], np.cumsum(self.byte_lengths[ids])])
        sizes = pc.binary_length(pa.array(plain + other, pa.large_string())).to_numpy().copy()
        sizes[:len(plain)] += 1  # the blank
        ends = np.searchsorted(id_ends, np.cumsum(sizes))
        n = len(self.slots) + len(self.firsts)
        at, more = self.ends[n], len(words) + len(firsts)
        if at + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(at + len(ids), 2 * len(self.ids)))
        if n + more + 1 > len(self.ends):
            self.ends = np.resize(self.ends, max(n + more + 1, 2 * len(self.ends)))
        self.ids[at:at + len(ids)] = ids
        self.ends[n + 1:n + 1 + more] = at + ends
        slots = np.empty(len(words), np.int64)
        slots[order] = np.arange(n, n + len(words))
        self.slots.update(zip(words, slots.tolist()))
        self.firsts.update(zip(firsts, range(n + len(words), n + more)))
        return slots, np.arange(n + len(words), n + more)

    def _find(self, words: list[str], firsts: list[str], distinct: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(slots of a blank and a word, slots of pieces as they are, long): and which of both are to be dropped after use.

        ``distinct`` words, as Arrow's dictionary gives them, are looked up once only."""
        known = np.fromiter(map(self.slots.get, words, itertools.repeat(-1)), np.int32, len(words))
        heads = np.fromiter(map(self.firsts.get, firsts, itertools.repeat(-1)), np.int32, len(firsts))
        lost = np.flatnonzero(known < 0)
        new = [words[i] for i in lost.tolist()]
        new = new if distinct else list(dict.fromkeys(new))
        started = list(dict.fromkeys(firsts[i] for i in np.flatnonzero(heads < 0).tolist()))
        if not new and not started:
            return known, heads, ([], [])
        sizes = list(map(len, new)), list(map(len, started))
        short, long = (new, started), ([], [])
        if max(itertools.chain(*sizes)) > PIECE_LENGTH:
            short = tuple([p for p, n in zip(x, m) if n <= PIECE_LENGTH] for x, m in zip((new, started), sizes))
            long = tuple([p for p, n in zip(x, m) if n > PIECE_LENGTH] for x, m in zip((new, started), sizes))
        more = sum(PIECE_BYTES + n for m in sizes for n in m if n <= PIECE_LENGTH) if any(long) else sum(PIECE_BYTES * len(m) + sum(m) for m in sizes)
        if self.size + more > MEMORY_BYTES and self.size:
            self._trim() if self.size > KEPT_BYTES else self._forget()
            return self._find(words, firsts, distinct)
        self.size += more
        slots, _ = self._learn(*short)
        if any(long):
            self._learn(*long)
        if distinct and not any(long):
            known[lost] = slots
        else:
            known[lost] = np.fromiter((self.slots[words[i]] for i in lost.tolist()), np.int64, len(lost))
        if started:
            heads = np.fromiter(map(self.firsts.__getitem__, firsts), np.int64, len(firsts))
        return known, heads, long

    def _drop(self, long: tuple) -> None:
        for table, pieces in zip((self.slots, self.firsts), long):  # they have the last slots
            for p in pieces:
                del table[p]
        if any(long) and len(self.ids) > 1 << 22:
            self.ids = self.ids[:max(1 << 20, int(self.ends[len(self.slots) + len(self.firsts)]))].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a string array; null counts as empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else np.empty(0, np.int64)
        ids, counts, at, total = [], [], 0, np.cumsum(sizes)
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GROUP_BYTES)))
            got, count = self._encode_group(texts.slice(at, stop - at))
            ids.append(got)
            counts.append(count)
            at = stop
        joined = np.concatenate(counts) if counts else np.empty(0, np.int64)
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.cumsum(joined)

    def _encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.added:
            holds = np.zeros(len(texts), bool)
            for token in self.added:
                holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            if holds.any():
                return self._around(texts, np.flatnonzero(holds))
        parts = pc.split_pattern(texts, " ")
        runs = np.flatnonzero(pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False))
        bounds = parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = parts.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), _strings(coded.dictionary)
        heads = bounds[:-1]  # the first piece of a text has no blank before it
        cut = [_CUT.split(texts[int(r)].as_py()) for r in runs]
        cut_firsts, cut_rest = [c[0] for c in cut], [p for c in cut for p in c[1:]]
        known, firsts, long = self._find(words + cut_rest, [words[c] for c in codes[heads].tolist()] + cut_firsts, not cut_rest)
        slots = known[:len(words)][codes]
        slots[heads] = firsts[:len(heads)]
        # pieces of the cut texts, in their order
        counts = np.array([len(c) for c in cut], np.int64)
        special = np.empty(counts.sum() if cut else 0, np.int64)
        if cut:
            first = np.zeros(len(special), bool)
            first[np.cumsum(counts) - counts] = True
            special[first], special[~first] = firsts[len(heads):], known[len(words):]
        each = np.diff(bounds)
        if len(runs):
            pieces, at, rest = [], 0, 0
            for r, c in zip(runs, cut):
                pieces += [slots[at:bounds[r]], special[rest:rest + len(c)]]
                at, rest, each[r] = bounds[r + 1], rest + len(c), len(c)
            slots = np.concatenate([*pieces, slots[at:]])
        # Arrow puts the pieces' ids together, without a number for each id
        n = len(self.slots) + len(self.firsts)
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends[:n + 1]), pa.array(self.ids[:self.ends[n]]))
        taken = lists.take(pa.array(slots))
        ids, sums = taken.flatten().to_numpy(), taken.offsets.to_numpy()
        self._drop(long)
        stops = np.cumsum(each)
        return ids, sums[stops] - sums[stops - each]

    def _around(self, texts: pa.Array, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold added tokens one by one by the library, those between them as ever."""
        ids, counts, at = [], [], 0
        for i in [*holds.tolist(), len(texts)]:
            if i > at:
                got, count = self._encode_group(texts.slice(at, i - at))
                ids.append(got)
                counts.append(count)
            if i < len(texts):
                ids.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
                counts.append(np.array([len(ids[-1])]))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; its memory serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
