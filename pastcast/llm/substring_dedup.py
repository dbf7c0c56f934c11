"""Near-duplicate passages across documents, by compact windows.

A text's tokens are its five-word shingles; a passage is a run of TOKENS of them, fifty words. For
each of FUNCTIONS hash functions the Cartesian tree over the tokens' hashes gives the text's compact
windows (l, c, r): every run of tokens inside l..r that holds c has its minimum at c. Only nodes at
least as wide as a passage matter. In a text, the compact windows of the two functions of a band are
joined as intervals of passage starts; all passages of a joint window share the band's signature,
the two minima. Across documents, joint windows with the same signature are grouped.

Passages of a group are verified. Windows with the same tokens are the same passage; in each group
they are tied to the first of them. The first ones of different content are compared, each with all
that it is not connected to, at every passage over their common minimum, and tied if at least
SIMILARITY of the tokens of both are common. Large groups are cut into cells of two blocks. Ties make
components; a group's pairs are compared in memory and only a spanning forest of them comes out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise
from .components import connected_components
from .pieces import WordCoder

SHINGLE = 5
#: Tokens of a passage: fifty words.
TOKENS = 46
SIMILARITY = 0.8
BANDS = 3
FUNCTIONS = 2 * BANDS
#: Texts read together, and texts whose equal windows are tied before the shuffle.
GROUP = 1024
#: Texts whose windows' surroundings are cut out together.
AROUND = 64
#: Windows with one signature are compared within cells of at most about twice so many.
CELL = 2048
#: Groups up to SMALL windows are compared all at once by distance; pairs and windows read at a time.
SMALL, COMPARED, WINDOWS = 8, 2048, 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tokens(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words of a sequence of word hashes."""
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * _MULTIPLIER + words[k:len(words) - SHINGLE + 1 + k].astype(np.uint64)
    return _mixed(out)


def _function(j: int, values: np.ndarray) -> np.ndarray:
    return _mixed(values + np.uint64((j + 1) * int(_MULTIPLIER) & (1 << 64) - 1))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        more = min(done, width - done)
        values = np.minimum(values[:len(values) - more], values[more:])
        done += more
    return values


def compact_windows(values: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes with r - l + 1 >= width, by c; of values equal in their
    upper 40 bits the left one is the smaller. ``ends`` are where the texts end in ``values``."""
    none = (np.empty(0, np.int64),) * 3
    if len(values) < width:
        return none
    low = np.uint64((1 << 24) - 1)
    values = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    least = sliding_minimum(values, width)
    text_end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(least)) + width <= text_end[:len(least)])
    if not len(at):
        return none
    # A node that wide is the minimum of some run of that width, and the runs with one minimum follow each other.
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    c = []
    runs = at[new]
    for begin in range(0, len(runs), 1 << 15):
        some = runs[begin:begin + (1 << 15)]
        c.append(some + np.argmin(values[some[:, None] + np.arange(width)], axis=1))
    c = np.unique(np.concatenate(c))
    own, v = text_end[c], values[c]
    # A node's bounds are its ancestors, which are as wide: nearest smaller ones among the nodes, by pointer jumping.
    before, after = np.arange(len(c)) - 1, np.arange(len(c)) + 1
    after[-1] = -1
    for near in (before, after):
        going = np.flatnonzero(near >= 0)
        while len(going):
            there = near[going]
            near[going[own[there] != own[going]]] = -1
            jump = going[(own[there] == own[going]) & (v[there] > v[going])]
            near[jump] = near[near[jump]]
            going = jump[near[jump] >= 0]
    text_start = own - np.diff(ends, prepend=0)[np.searchsorted(ends, own)]
    return np.where(before >= 0, c[before] + 1, text_start), c, np.where(after >= 0, c[after], own) - 1


def joint_windows(values: list[np.ndarray], ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(signature, first start, last start, centre) of passages that share the minima of both functions."""
    sides = []
    for v in values:
        left, c, right = compact_windows(v, ends, width)
        low, high = np.maximum(left, c - width + 1), np.minimum(c, right - width + 1)
        some = low <= high
        sides.append((low[some], high[some], c[some], v[c[some]]))
    (low1, high1, c1, v1), (low2, high2, _, v2) = sides
    start = np.unique(np.concatenate([low1, low2]))
    a, b = np.searchsorted(low1, start, side="right") - 1, np.searchsorted(low2, start, side="right") - 1
    some = (a >= 0) & (b >= 0)
    start, a, b = start[some], a[some], b[some]
    stop = np.minimum(high1[a], high2[b])
    some = start <= stop
    start, stop, a, b = start[some], stop[some], a[some], b[some]
    return _mixed(v1[a] * _MULTIPLIER + v2[b]), start, stop, c1[a]


def _pack(first: np.ndarray, last: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """A window's starts and centre in one number."""
    return (first << 16) | ((last - first) << 8) | (centre - first)


def _first(place: Column) -> Column:
    return F.shiftright(place, 16)


def _last(place: Column) -> Column:
    return _first(place) + F.shiftright(place, 8).bitwiseAND(F.lit(255))


def document_windows(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, signature, place, content) of all joint windows of the texts, a row per text, signature
    and content.

    ``codes`` are word hashes end to end. content is the sum of the tokens of all its passages.
    """
    values = tokens(codes)
    sizes = np.maximum(np.diff(ends, prepend=0) - SHINGLE + 1, 0)
    # The runs that start in one text and end in the next are no tokens: leave them out.
    starts = ends - np.diff(ends, prepend=0)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    values, token_ends = values[inside], np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    out = []
    for band in range(BANDS):
        pair = [_function(2 * band + k, values) for k in range(2)]
        signature, first, last, centre = joint_windows(pair, token_ends, TOKENS)
        text = np.searchsorted(token_ends, first, side="right")
        begin = (token_ends - sizes)[text]
        content = sums[last + TOKENS] - sums[first]
        out.append((text, _mixed(signature + np.uint64(band)), _pack(first - begin, last - begin, centre - begin), content))
    text, signature, place, content = (np.concatenate(x) for x in zip(*out))
    # A passage repeated inside a text counts once; others that share its signature stay.
    order = np.lexsort((place, content, signature, text))
    text, signature, place, content = text[order], signature[order], place[order], content[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (signature[1:] != signature[:-1]) | (content[1:] != content[:-1])
    return text[new], signature[new], place[new], content[new]


_WINDOW = "route bigint, signature bigint, content bigint, id bigint, place bigint, other bigint, other_place bigint"
_TIE = "signature bigint, content bigint, id bigint, place bigint, other bigint, other_place bigint"
_AROUND = "signature bigint, blocks int, id bigint, centre bigint, before int, after int, run binary"
_LINK = "id bigint, first bigint, end bigint, other bigint, other_first bigint, similarity double"


def _hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _WINDOW. Windows of equal signature and content within a group of texts are tied to the
    first here; ``other`` is set in those rows, and only the first goes to where its signature is dealt."""
    coder = WordCoder(_hash_words)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for begin in range(0, batch.num_rows, GROUP):
            texts = batch.column(1).slice(begin, GROUP)
            text, signature, place, content = document_windows(*coder.code(texts))
            own = ids[begin + text]
            order = np.lexsort((own, content, signature))
            own, signature, place, content = own[order], signature[order], place[order], content[order]
            new = np.ones(len(own), bool)
            new[1:] = (signature[1:] != signature[:-1]) | (content[1:] != content[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0)) if len(own) else np.empty(0, np.int64)
            route = np.where(new, signature, _mixed(signature + own.astype(np.uint64) * _MULTIPLIER))
            columns = [route.view(np.int64), signature.view(np.int64), content.view(np.int64), own, place,
                       np.where(new, own, own[head]), np.where(new, -1, place[head])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [
                "route", "signature", "content", "id", "place", "other", "other_place"])


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _TIE from windows sorted by signature and content: windows tied to the first of their content, and,
    with other_place -1, the first of each content where a signature has several. A group may go on over
    batches: its first row and the first row of its content are all that is kept of it."""
    names = ["signature", "content", "id", "place", "other", "other_place"]
    held = np.empty((4, 0), np.int64)  # signature, content, id, place
    for batch in batches:
        tied = batch.column(6).to_numpy() >= 0
        out = [[batch.column(i).to_numpy()[tied] for i in range(1, 7)]]
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy()[~tied] for i in (1, 2, 3, 4)])], axis=1)
        n, known = rows.shape[1], held.shape[1]
        if n:
            at = np.arange(n)
            new = np.ones(n, bool)
            new[1:] = rows[0, 1:] != rows[0, :-1]
            other = new.copy()
            other[1:] |= rows[1, 1:] != rows[1, :-1]
            group, content = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(other, at, 0))
            fresh = at >= known
            a, b = at[fresh & ~other], content[fresh & ~other]
            out.append([*rows[:, a], rows[2, b], rows[3, b]])
            more = at[fresh & other & ~new]
            first = np.unique(group[more])
            if known == 2:  # with a second content held, the group's first row is out already
                first = first[first > 0]
            heads = np.concatenate([first, more])
            out.append([*rows[:, heads], rows[2, heads], np.full(len(heads), -1)])
            held = rows[:, sorted({int(group[-1]), int(content[-1])})]
        columns = [np.concatenate(x) for x in zip(*out)]
        keep = (columns[2] != columns[4]) | (columns[5] < 0)
        for x in columns[:2]:  # of use in the rows of groups alone
            x[columns[5] >= 0] = 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names)


def _around(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of _AROUND: the lower 32 bits of the tokens up to TOKENS - 1 before and after each window's centre."""
    # At most a few windows for each word of a text.
    wanted = heads.groupBy("id").agg(F.collect_list(F.struct("signature", "content", "place", "blocks")).alias("wants"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(_hash_words)
        for batch in batches:
            for begin in range(0, batch.num_rows, AROUND):
                rows = batch.slice(begin, AROUND)
                codes, ends = coder.code(rows.column(1))
                out = []
                for i, own in enumerate(rows.column(0).to_pylist()):
                    values = tokens(codes[(ends[i - 1] if i else 0):ends[i]])
                    wants = rows.column(2)[i].values
                    signature, content, place, blocks = (wants.field(k).to_numpy() for k in range(4))
                    first = place >> 16
                    last, centre = first + ((place >> 8) & 255), first + (place & 255)
                    # Rows may share an id: the window is of the text that has its content.
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
                    mine = np.flatnonzero(last + TOKENS <= len(values))
                    mine = mine[sums[last[mine] + TOKENS] - sums[first[mine]] == content[mine].view(np.uint64)]
                    if not len(mine):
                        continue
                    centre = centre[mine]
                    run = np.pad(values.astype(np.uint32), TOKENS - 1)[centre[:, None] + np.arange(2 * TOKENS - 1)]
                    out.append((signature[mine], blocks[mine], np.full(len(mine), own), centre, np.minimum(centre, TOKENS - 1),
                                np.minimum(len(values) - 1 - centre, TOKENS - 1), run))
                if not out:
                    continue
                signature, blocks, ids, centre, before, after, run = (np.concatenate(x) for x in zip(*out))
                offsets = np.arange(len(run) + 1, dtype=np.int32) * (run.shape[1] * run.itemsize)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signature), pa.array(blocks), pa.array(ids), pa.array(centre), pa.array(before, pa.int32()), pa.array(after, pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(run))])],
                    ["signature", "blocks", "id", "centre", "before", "after", "run"])

    return docs.join(wanted, "id").select("id", "text", "wants").mapInArrow(cut, _AROUND)


def repeats(run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """By row and start: how many tokens of the passage, from place start to start + TOKENS - 1, are there at an
    earlier column of it too. ``place`` is each column's, ascending."""
    order = np.argsort(run, axis=1, kind="stable")
    run = np.take_along_axis(run, order, 1)
    row, k = np.nonzero(run[:, 1:] == run[:, :-1])
    begin = np.maximum(0, place[order[row, k + 1]] - TOKENS + 1)
    stop = np.minimum(TOKENS - 1, place[order[row, k]]) + 1
    some = begin < stop
    row, size = row[some] * (TOKENS + 1), len(run) * (TOKENS + 1)
    steps = np.bincount(row + begin[some], minlength=size) - np.bincount(row + stop[some], minlength=size)
    return np.cumsum(steps.reshape(len(run), TOKENS + 1), axis=1)[:, :TOKENS]


class Surroundings:
    """Windows by their tokens around the common minimum, the centre: ``run`` has 2 * TOKENS - 1 columns, of which
    ``before`` ahead of the middle one and ``after`` behind it are tokens."""

    def __init__(self, run: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.run, self.before, self.after = run, before, after
        place = np.arange(1 - TOKENS, TOKENS)
        self.real = (place >= -before[:, None]) & (place <= after[:, None])
        ordered = np.sort(np.where(self.real, run, ~run.dtype.type(0)), axis=1)
        self.distinct = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1) - ~self.real.all(axis=1)
        self.repeats = repeats(run, np.arange(2 * TOKENS - 1))
        # The fewest tokens that a similar passage has in common with one of this window.
        starts = np.arange(TOKENS)
        inside = (starts >= TOKENS - 1 - before[:, None]) & (starts <= after[:, None])
        self.need = -(-4 * (TOKENS - np.where(inside, self.repeats, 0).max(axis=1, initial=0)) // 5)
        flags = np.zeros((len(run), 1024), bool)
        flags[np.broadcast_to(np.arange(len(run))[:, None], run.shape)[self.real], (run[self.real] & run.dtype.type(1023)).astype(np.int64)] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)

    def may(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """False only for pairs without similar passages: too many tokens of one are none of the other."""
        one, two = self.bits[a], self.bits[b]
        alone = self.distinct[a] - np.bitwise_count(one & ~two).sum(axis=-1, dtype=np.int64) >= self.need[a]
        return alone & (self.distinct[b] - np.bitwise_count(two & ~one).sum(axis=-1, dtype=np.int64) >= self.need[b])

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(linked, first, last, similarity) of pairs: every passage over the centre at one distance from it in both is
        compared. first and last are starts, from the run's first column: of the similar passages that begin and
        end with the same token, or else of the one most alike."""
        m, starts = len(a), np.arange(TOKENS)
        both = np.stack([self.run[a], self.run[b]], axis=2).reshape(m, -1)
        common = repeats(both, np.arange(both.shape[1]) // 2) - self.repeats[a] - self.repeats[b]
        alike = common / (2 * TOKENS - self.repeats[a] - self.repeats[b] - common)
        low = TOKENS - 1 - np.minimum(self.before[a], self.before[b])
        high = np.minimum(self.after[a], self.after[b])
        good = (alike >= SIMILARITY) & (starts >= low[:, None]) & (starts <= high[:, None])
        even = self.run[a] == self.run[b]
        closed = good & even[:, :TOKENS] & even[:, TOKENS - 1:]
        best = np.argmax(np.where(good, alike, -1), axis=1)
        whole = closed.any(axis=1)
        first = np.where(whole, np.argmax(closed, axis=1), best)
        last = np.where(whole, TOKENS - 1 - np.argmax(closed[:, ::-1], axis=1), best)
        similarity = np.where(whole, np.where(closed, alike, 2).min(axis=1), alike[np.arange(m), best])
        return good.any(axis=1), first, last, similarity


def link_windows(around: Surroundings, group: np.ndarray, block: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """(a, b, first, last, similarity) of similar passages that connect the windows of each group; windows are
    sorted by group. In a group of two blocks the pairs between them are compared, else all; never two
    windows of one text, nor windows that are connected already."""
    n, out = len(group), []
    root = np.arange(n)
    begins = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    lowest, highest = (f.reduceat(block, begins) if n else block for f in (np.minimum, np.maximum))
    mixed = np.repeat(lowest != highest, sizes)

    def check(a, b):
        a, b = (x[(ids[a] != ids[b]) & (root[a] != root[b]) & ~(mixed[a] & (block[a] == block[b]))] for x in (a, b))
        for at in range(0, len(a), COMPARED):
            p, q = a[at:at + COMPARED], b[at:at + COMPARED]
            near = around.may(p, q) & (root[p] != root[q])
            p, q = p[near], q[near]
            if not len(p):
                continue
            linked, *rest = around.compare(p, q)
            p, q, rest = p[linked], q[linked], [x[linked] for x in rest]
            forest = np.zeros(len(p), bool)
            for k, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    forest[k] = True
            out.append((p[forest], q[forest], *(x[forest] for x in rest)))

    def flatten(low, high):
        while not np.array_equal(jumped := root[root[low:high]], root[low:high]):
            root[low:high] = jumped

    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL):  # all small groups together, by distance
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        check(at, at + step)
        flatten(0, n)
    for begin, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for row in range(begin, begin + size - 1):
            rest = row + 1 + np.flatnonzero((root[row + 1:begin + size] != root[row]) & (ids[row + 1:begin + size] != ids[row]))
            if not len(rest):
                if (root[begin:begin + size] == root[begin]).all():
                    break
                continue
            before = len(out)
            check(np.full(len(rest), row), rest)
            if len(out) > before:
                flatten(begin, begin + size)
    return out


def _near(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of _LINK: similar passages that connect the windows of different content of each signature.

    A signature with more than CELL of them is cut into blocks; every pair of blocks is a cell.
    """
    blocks = materialise(heads.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
                         .select("signature", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")), "blocks")
    # The windows' shuffle is not needed any more: Spark removes it once its plan is collected.
    docs.sparkSession.sparkContext._jvm.System.gc()
    # A row of blocks stands for over CELL windows.
    heads = heads.join(F.broadcast(blocks), "signature", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64(F.lit("block"), "id", "centre"), F.col("blocks")).cast("int")
    celled = (_around(docs, heads)
              .withColumn("block", block).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("signature", (F.least("block", "beside") * F.col("blocks") + F.greatest("block", "beside")).alias("cell"),
                      "block", "id", "centre", "before", "after", "run"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * TOKENS - 1
        held = None

        def edges(signature, cell, block, ids, centre, before, after, run):
            new = np.ones(len(signature), bool)
            new[1:] = (signature[1:] != signature[:-1]) | (cell[1:] != cell[:-1])
            found = link_windows(Surroundings(run, before, after), np.cumsum(new), block, ids)
            found.append((np.empty(0, np.int64),) * 4 + (np.empty(0),))
            a, b, first, last, similarity = (np.concatenate(x) for x in zip(*found))
            first = first - TOKENS + 1
            begin = centre[a] + first
            end = centre[a] + last - TOKENS + 1 + TOKENS + SHINGLE - 1
            columns = [ids[a], begin, end, ids[b], centre[b] + first, similarity]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "first", "end", "other", "other_first", "similarity"])

        for batch in batches:
            data = batch.column(7)
            spots = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]
            run = np.frombuffer(data.buffers()[2], np.uint8)[spots[0]:spots[-1]].view(np.uint32).reshape(-1, width) if len(data) else np.empty((0, width), np.uint32)
            rows = [batch.column(i).to_numpy().astype(np.int64) for i in range(7)] + [run]
            if not len(rows[0]):
                continue
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            # The last group may go on in the next batch.
            apart = (rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])
            last = len(apart) - int(np.argmax(apart[::-1])) if apart.any() else 0
            held = [r[last:].copy() for r in rows]
            for part in _whole_groups(rows, last):
                yield edges(*part)
        if held is not None:
            yield edges(*held)

    dealt = celled.repartition("signature", "cell").sortWithinPartitions("signature", "cell")
    return dealt.mapInArrow(link, _LINK)


def _whole_groups(rows: list[np.ndarray], stop: int) -> Iterator[list[np.ndarray]]:
    """The rows up to ``stop`` in parts of about WINDOWS rows that cut no group."""
    new = np.flatnonzero((np.diff(rows[0][:stop], prepend=0) != 0) | (np.diff(rows[1][:stop], prepend=0) != 0))
    begin = 0
    while begin < stop:
        k = np.searchsorted(new, begin + WINDOWS)
        end = int(new[k]) if k < len(new) else stop
        yield [r[begin:end] for r in rows]
        begin = end


def _touching(found: DataFrame) -> DataFrame:
    """Folds the rows of one (id, other, shift) that overlap or are next to each other."""
    pair = W.partitionBy("id", "other", "shift").orderBy("first")
    reached = F.max("end").over(pair.rowsBetween(W.unboundedPreceding, -1))
    cut = found.withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    return (cut.withColumn("island", F.sum("new").over(pair.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .groupBy("id", "other", "shift", "island")
            .agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("similarity").alias("similarity")).drop("island"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, match_<id>, first_word, end_word, match_first_word, similarity, group_id): a row for each passage of
    fifty words or more that a document shares with the one it is tied to, and one the other way round.

    Words are lower-cased and stripped of what is neither letter nor digit. Ids are whole numbers.
    A document has a row if any of its passages repeats in another, and group_id is the smallest id
    that such rows reach. Equal passages are always tied (similarity 1); others need a common
    signature, which two passages of similarity 0.8 have in a window with a chance over 0.95, and
    are compared at every start over their common minimum. Rows
    with a null id or text, and texts of under fifty words, have no passage. Rows that repeat an id
    are read as one document, and passages repeated inside a document are not reported. An empty
    table gives an empty result. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    dealt = slim.mapInArrow(_windows, _WINDOW).repartition("route").sortWithinPartitions("signature", "content", "id")
    ties = materialise(dealt.mapInArrow(_ties, _TIE), "ties")
    end = lambda c: _last(F.col(c)) + TOKENS + SHINGLE - 1
    equal = ties.filter("other_place >= 0").select("id", "other", _first(F.col("place")).alias("first"), end("place").alias("end"),
                                       _first(F.col("other_place")).alias("other_first"), F.lit(1.0).alias("similarity"))
    near = _near(slim, ties.filter("other_place < 0")).select("id", "other", "first", "end", "other_first", "similarity")
    # Windows of one passage lie at one distance in both texts and touch each other.
    turned, shift = F.col("id") > F.col("other"), F.col("first") - F.col("other_first")
    found = equal.union(near).select(
        F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), F.when(turned, -shift).otherwise(shift).alias("shift"),
        F.when(turned, F.col("other_first")).otherwise(F.col("first")).alias("first"),
        F.when(turned, F.col("end") - shift).otherwise(F.col("end")).alias("end"), "similarity")
    passages = materialise(_touching(found), "passages")
    stars = connected_components(passages.select(F.col("id").alias("u"), F.col("other").alias("v")).distinct())
    there = F.col("first") - F.col("shift")
    size = F.col("end") - F.col("first")
    both = passages.select("id", F.col("other").alias("match"), F.col("first").alias("first_word"), F.col("end").alias("end_word"),
                           there.alias("match_first_word"), "similarity").union(
        passages.select("other", "id", there, there + size, "first", "similarity"))
    return both.join(stars, both["id"] == stars["node"]).select(
        F.col("id").alias(id_col), F.col("match").alias(f"match_{id_col}"), "first_word", "end_word", "match_first_word",
        "similarity", F.col("component").alias("group_id"))
