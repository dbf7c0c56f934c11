"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once as a whole. Its tokens and its sections are both intervals that tile its
bytes, so their join is a search of token starts and ends among section ends. A token inside one
section counts there; a token across a boundary is allocated by the rule:

``start``    to the section of its first byte,
``end``      to the section of its last byte,
``largest``  to the section that holds most of its bytes, the first of them if equal,
``split``    to each section by its share of the token's bytes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Texts counted together; bounds the memory of a task.
GROUP = 1024
RULES = ("start", "end", "largest", "split")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section; both kinds of intervals tile the same bytes from 0 on."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    solid = token_ends > starts
    starts, ends = starts[solid], token_ends[solid]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    whole = first == last
    counts = np.bincount(first[whole], minlength=n).astype(float)
    first, last, starts, ends = (x[~whole] for x in (first, last, starts, ends))
    # The boundary tokens, once for each section from their first to their last.
    many = last - first + 1
    token = np.repeat(np.arange(len(first)), many)
    section = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[token]
    section_starts = np.concatenate([[0], section_ends[:-1]]) if n else section_ends
    share = np.minimum(ends[token], section_ends[section]) - np.maximum(starts[token], section_starts[section])
    token, section, share = token[share > 0], section[share > 0], share[share > 0]
    crossing = np.bincount(section, minlength=n)
    if rule == "start":
        counts += np.bincount(first, minlength=n)
    elif rule == "end":
        counts += np.bincount(last, minlength=n)
    elif rule == "split":
        counts += np.bincount(section, weights=share / (ends - starts)[token], minlength=n)
    else:
        order = np.lexsort((section, -share, token))
        best = order[np.unique(token[order], return_index=True)[1]]
        counts += np.bincount(section[best], minlength=n)
    return counts, crossing


def _line_ends(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section ends, their documents): lines with their newline; an empty text is one empty line."""
    newlines = np.flatnonzero(data == 10) + 1
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    closed = np.zeros(len(doc_ends), bool)
    full = doc_ends > doc_starts
    closed[full] = data[doc_ends[full] - 1] == 10
    open_docs = np.flatnonzero(~closed)
    docs = np.concatenate([np.searchsorted(doc_ends, newlines), open_docs])
    ends = np.concatenate([newlines, doc_ends[open_docs]])
    order = np.lexsort((ends, docs))
    return ends[order], docs[order]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] | None = None,
                 rule: str = "largest", tokenizer: str | None = None) -> DataFrame:
    """A row per section: id, section (from 0), start_char, end_char, n_tokens, n_crossing.

    Sections are the lines of ``text_col`` (with their newline), or ``fields``, joined by newlines
    that count with the field before. n_tokens is a double, whole unless the rule is ``split``; its
    sum over a document is the document's token count. n_crossing counts tokens that lie in this
    section and another. Null texts and fields are empty; an empty text has one empty section with
    no token. Ids may be null or repeated: each row has its own sections, in order of appearance.
    Other columns are not read. ``tokenizer`` is a file of the tokenizers library, present on all
    machines; the default is the 50k byte-level vocabulary.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if fields:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
        text, sizes = F.concat_ws("\n", *parts), F.array(*[
            F.octet_length(p) + (0 if p is parts[-1] else 1) for p in parts])
    else:
        text, sizes = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(None).cast("array<int>")
    slim = df.select(F.col(id_col).alias("id"), text.alias("text"), sizes.alias("sizes"))

    def count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        doc_ends = offsets[1:] - offsets[0]
        if fields:
            ends = np.concatenate([np.cumsum(s) for s in batch.column(2).to_pylist()]).astype(np.int64)
            docs = np.repeat(np.arange(len(texts)), len(fields))
            ends += np.concatenate([[0], doc_ends[:-1]])[docs]
        else:
            ends, docs = _line_ends(data, doc_ends)
        worker = encoder(tokenizer)
        ids, _ = worker.encode(batch.column(1))
        counts, crossing = allocate(np.cumsum(worker.byte_lengths[ids]), ends, rule)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = np.concatenate([[0], ends[:-1]])
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        first = np.searchsorted(docs, docs)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(docs)), pa.array(np.arange(len(docs)) - first, pa.int32()),
            pa.array(chars[starts] - chars[doc_starts[docs]], pa.int64()),
            pa.array(chars[ends] - chars[doc_starts[docs]], pa.int64()),
            pa.array(counts), pa.array(crossing, pa.int64())],
            ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, GROUP):
                yield count_batch(whole.slice(begin, GROUP))

    kind = dict(slim.dtypes)["id"]
    out = slim.mapInArrow(count, f"id {kind}, section int, start_char bigint, end_char bigint, n_tokens double, n_crossing bigint")
    return out.withColumnRenamed("id", id_col)
