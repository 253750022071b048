"""Arrow text batches as terms: maximal runs of "term bytes", A-Z lower-cased.

A term byte is one that a 256-entry table maps to a non-zero byte (its folded
value). Bytes of 0x80 and above are always term bytes, so byte positions cut
terms exactly as a pattern over code points does.

Texts are handled in segments of about ``BLOCK`` bytes: a segment holds several
whole rows, or one piece of a longer row, cut between two terms (a single term
longer than a segment stays whole). Memory therefore follows the segment, or
the longest term, and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ._text import utf8

BLOCK = 4 << 20


def fold_table(digits: bool) -> np.ndarray:
    """Bytes of letters (and digits) to their A-Z folded value, others to 0."""
    t = np.zeros(256, np.uint8)
    t[97:123] = t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    if digits:
        t[48:58] = np.arange(48, 58)
    return t


LETTERS = fold_table(False)
LETTERS_DIGITS = fold_table(True)


@dataclass
class Segment:
    """``terms``: distinct terms (binary array); ``code[i]`` is the term of
    occurrence ``i`` and ``row[i]`` its row in the batch. ``rows`` are the rows
    in the segment; ``first``/``last`` tell whether it begins and ends them."""

    terms: pa.Array
    code: np.ndarray
    row: np.ndarray
    rows: range
    first: bool = True
    last: bool = True

    @property
    def whole(self) -> bool:
        return self.first and self.last


def _terms(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    low = table[data]
    keep = low != 0
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    edge = off[:-1][off[:-1] < len(data)]  # a row's first byte begins a term
    begin[edge] = keep[edge]
    at = np.flatnonzero(begin)
    row = np.searchsorted(off, at, "right") - 1
    flat = low[keep]
    starts = np.flatnonzero(begin[keep])
    ends = np.r_[starts, len(flat)].astype(np.int32)
    arr = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    enc = arr.dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy(zero_copy_only=False), row


def segments(column: pa.Array, table: np.ndarray, block: int = BLOCK) -> Iterator[Segment]:
    """The terms of a string column, segment by segment; NULL has none."""
    data, off = utf8(column)
    n, r = len(off) - 1, 0
    while r < n:
        stop = max(r + 1, int(np.searchsorted(off, off[r] + block, "right")) - 1)
        a, b = int(off[r]), int(off[stop])
        if b - a <= block:
            yield Segment(*(x + r if i == 2 else x for i, x in
                            enumerate(_terms(data[a:b], off[r:stop + 1] - a, table))), range(r, stop))
        else:  # one long row
            first = True
            while first or a < b:
                cut = min(b, a + block)
                while cut < b:  # back to, or else on to, a byte between terms
                    gap = np.flatnonzero(table[data[a:cut]] == 0)
                    if len(gap):
                        cut = a + int(gap[-1]) + 1
                        break
                    cut = min(b, cut + block)
                terms, code, row = _terms(data[a:cut], np.array([0, cut - a]), table)
                yield Segment(terms, code, row + r, range(r, r + 1), first, cut == b)
                a, first = cut, False
        r = stop
