"""Words of many texts at once: Arrow splits and numbers the pieces, Python sees each distinct one of a call once.

Nothing is remembered from call to call: most pieces of a large corpus come once, and a memory of them would cost
more than it saves.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Other memories of pieces: their bytes in a worker, what a piece takes beside its characters, how long it may be.
MEMORY_BYTES, PIECE_BYTES, PIECE_LENGTH = 32 << 20, 150, 64


def strip_word(piece: str) -> str:
    """Lower case, without what is neither letter nor digit at both ends; may be empty."""
    a, b = 0, len(piece)
    while a < b and not piece[a].isalnum():
        a += 1
    while b > a and not piece[b - 1].isalnum():
        b -= 1
    return piece[a:b].lower()


class WordCoder:
    """Numbers for the words of texts: ``numbers`` maps a list of stripped words to as many whole numbers of 64 bits.

    Words without a letter or digit are left out altogether.
    """

    def __init__(self, numbers: Callable[[list[str]], np.ndarray]):
        self.numbers = numbers

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, ends): the words' numbers end to end, and where each text's words end."""
        spaced = texts.fill_null("").cast(pa.large_string())
        for c in "\n\t\r\x0b\x0c":
            if pc.any(pc.match_substring(spaced, c)).as_py():
                spaced = pc.replace_substring(spaced, c, " ")
        parts = pc.split_pattern(spaced, " ")
        if not len(parts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        # Most pieces begin and end with a letter or digit.
        words = [p.lower() if p[:1].isalnum() and p[-1].isalnum() else strip_word(p) for p in coded.dictionary.to_pylist()]
        entries, some = self.numbers(words), np.fromiter(map(bool, words), bool, len(words))
        codes = coded.indices.to_numpy()
        numbers = entries[codes]
        if some.all():
            return numbers, ends
        real = some[codes]
        return numbers[real], np.concatenate([[0], np.cumsum(real)])[ends]
