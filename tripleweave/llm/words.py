"""Words of whole text columns as arrays, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tripleweave.llm.tables import raw

# Bytes that end a word, of every operator that counts words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a column of texts, in order.

    ``data`` holds all bytes, word w is ``data[begin[w]:end[w]]``, and text t has the words
    ``first[t] .. first[t + 1] - 1``. No word crosses texts.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = SPACES, mapped: np.ndarray | None = None):
        self.data, self.offsets = raw(column)
        if mapped is not None:
            self.data = mapped[self.data]
        inside = ~between[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        self.begin = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        self.end = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        self.first = np.searchsorted(self.begin, self.offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.begin)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def arrow(self) -> pa.LargeBinaryArray:
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.begin, out=offsets[1:])
        held = [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self._inside])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), held)
