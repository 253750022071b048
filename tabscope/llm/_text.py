"""Arrow text batches as numpy byte arrays: words, word hashes, windows.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. No UTF-8 continuation or
lead byte lies in that set, so byte positions cut words exactly as the pattern
``[^\\x20\\x09-\\x0D]+`` does on characters.

All helpers work on one block of rows at a time. Hash scratch space is bounded
by ``SEGMENT`` bytes (or one word, if a single word is longer), so a very long
text costs a few numbers per word, not per byte.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, and bytes hashed at once.
BLOCK = 4 << 20
SEGMENT = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


SPACE = _space_table()


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection on 64 bits)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: One random 64-bit value per byte; the second table folds A-Z to a-z.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _MULT)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
    inv = pow(base, -1, 1 << 64)
    return (np.cumprod(np.r_[_U(1), np.full(n, base, _U)], dtype=_U),
            np.cumprod(np.r_[_U(1), np.full(n, inv, _U)], dtype=_U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[off[0]:off[-1]], off - off[0]


def blocks(batches, column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about ``limit`` text bytes (a row
    is never cut). Behind the last one, memory that is free goes back to the
    system: the worker may be kept for tasks of other stages."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Words:
    """Word positions of a block: ``start``/``end`` byte positions in ``data``
    and ``row``, the row each word belongs to; ``first[r]:first[r + 1]`` are the
    words of row ``r``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a row begins here
        edge[off] = True
        before = np.r_[False, word[:-1]] if len(data) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.r_[word[1:], False] if len(data) else word
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """64-bit hash of each word (``fold_case``: A-Z as a-z)."""
        return span_hashes(self.data, self.start, self.end, fold_case)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                fold_case: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ascending, non-overlapping byte spans: a polynomial in
    an odd base over random byte values modulo 2**64, then mixed with the
    length. Each ``seed`` is another hash."""
    table = _FOLD if fold_case else _BYTE
    if seed:
        table = mix(table ^ _U(seed))
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + SEGMENT, "right")))
        b = int(end[j - 1])
        power, inverse = _powers(max(SEGMENT, b - a))
        c = np.zeros(b - a + 1, _U)
        np.cumsum(table[data[a:b]] * power[:b - a], out=c[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (c[e] - c[s]) * inverse[s]
        i = j
    return mix(out ^ ((end - start).astype(_U) * _MULT))


def window_hashes(h: np.ndarray, row: np.ndarray, first: np.ndarray, n: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of each window of ``n`` words within one row."""
    if len(h) < n:
        return h[:0], np.zeros(0, np.int64)
    count = len(h) - n + 1
    out = np.zeros(count, _U)
    for k in range(n):
        out = out * _MULT + h[k:k + count]
    at = np.flatnonzero(row[:count] == row[n - 1:n - 1 + count])
    return mix(out[at]), at


class IdTable:
    """Ids of distinct strings, remembered up to ``room`` strings (those met
    first, which are the frequent ones)."""

    def __init__(self, room: int):
        self.room = room
        self.at: dict[str, int] = {}
        self.start, self.size, self.flat = array("q"), array("q"), array("I")

    def get(self, string: str):
        i = self.at.get(string)
        return None if i is None else self.flat[self.start[i]:self.start[i] + self.size[i]]

    def rows(self, strings: list[str], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids) of distinct ``strings``: string ``k`` has the ids
        ``start[k]`` to ``start[k] + size[k]``. ``encode`` gets the unknown ones."""
        at = self.at
        new = [s for s in strings if s not in at]
        known = len(self.start)
        for s, ids in zip(new, encode(new)):
            at[s] = len(self.start)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)
        which = np.fromiter(map(at.__getitem__, strings), np.int64, len(strings))
        out = np.array(self.start)[which], np.array(self.size)[which], np.array(self.flat, np.uint32)
        if len(self.start) > self.room:
            keep = max(known, self.room)
            for s in new[keep - known:]:
                del at[s]
            del self.flat[self.start[keep]:]
            del self.start[keep:], self.size[keep:]
        return out


def spell(which: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, end of each item) of the items ``which`` of an id table."""
    n = size[which]
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.arange(total) + np.repeat(start[which] - (upto - n), n)], upto
