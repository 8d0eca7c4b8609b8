"""Words of many texts at once, from the bytes of an Arrow column: no loop over words.

Separators are ASCII, and no byte of a longer UTF-8 character is ASCII, so words can be cut bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once; a longer text is cut alone.
SLICE_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Every word of a slice of texts: its code in ``vocabulary``, the row and the piece (numbered on) it lies in."""

    codes: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    vocabulary: pa.Array


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each (a longer text alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


def cut(texts: pa.Array, blanks: np.ndarray, breaks: np.ndarray) -> Words:
    """The words of the texts, A-Z lower-cased; ``blanks`` and ``breaks`` mark the bytes that end words and pieces.

    Null counts as empty.  Words of different rows never share a piece.
    """
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(column)
    # a break byte after each row, so that no word or piece runs on into the next one
    joined = pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + n + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if n else np.zeros(0, np.uint8)
    low = _LOWER[data]
    inside = np.r_[False, ~(blanks | breaks)[low], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # start, end, start, end ...
    if not len(edges):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()))
    edges = edges.astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1,
                                             [None, pa.py_buffer(edges), pa.py_buffer(low)])
    words = parts.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    starts = edges[::2]
    rows = np.searchsorted(offsets[1:] - offsets[0], starts, side="right")
    pieces = np.searchsorted(np.flatnonzero(breaks[low]), starts)
    return Words(words.indices.to_numpy().astype(np.int64), rows, pieces,
                 words.dictionary.cast(pa.large_string()).cast(pa.string()))
