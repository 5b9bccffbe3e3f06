"""Vectorised text helpers that the tasks of several operators share.

A batch of texts is handled as one byte array: A-Z is lower-cased, words are the maximal runs of bytes other than
space and 0x09-0x0D, and no word crosses the end of its text.  Every function works on one bounded block of texts
(``blocks``), so that a task's memory doesn't depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside of search terms: ASCII but letters and digits.
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[48:58] = NO_TERM[65:91] = NO_TERM[97:123] = NO_TERM[128:] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the whole result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Some consecutive texts of a batch: rows ``first`` to ``first + n``."""

    first: int
    n: int
    data: np.ndarray  # bytes of all the texts, one after another
    bounds: np.ndarray  # n + 1 offsets into data

    def parts(self, most: int) -> Iterator[Block]:
        """The block in parts of up to so many texts."""
        for low in range(0, self.n, most):
            bounds = self.bounds[low : min(low + most, self.n) + 1]
            yield Block(self.first + low, len(bounds) - 1, self.data[bounds[0] : bounds[-1]], bounds - bounds[0])


def blocks(texts: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of texts (null: empty) into blocks of about ``max_bytes``, at least one text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1)
        bounds = offsets[first : last + 1]
        yield Block(first, last - first, whole[bounds[0] : bounds[-1]], bounds - bounds[0])
        first = last


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # the text that a word belongs to, counted within the block
    lower: np.ndarray  # the block's bytes in lower case


def words(block: Block, outside: np.ndarray = _SPACE) -> Words:
    """All words of a block, in order: the longest runs of bytes that ``outside`` doesn't have."""
    lower = _LOWER[block.data]
    inside = ~outside[lower]
    n = len(lower)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, lower)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = block.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(block.n), np.diff(np.searchsorted(start, block.bounds)))
    return Words(start, end, row, lower)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(w.lower))
    total = np.zeros(len(w.lower) + 1, dtype=np.uint64)
    np.cumsum((w.lower.astype(np.uint64) + np.uint64(1)) * up[: len(w.lower)], out=total[1:])
    return mix64((total[w.end] - total[w.start]) * down[w.start] ^ ((w.end - w.start).astype(np.uint64) << np.uint64(56)))


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of up to five word hashes."""
    total = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for k, x in enumerate(columns):
        total += x * _ROLES[k]
    return mix64(total)


def shingles(w: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each five-word shingle; a text of one to four words has one shingle, its whole sequence."""
    h = word_hashes(w)
    counts = np.bincount(w.row, minlength=n_rows)
    rows, out = [], []
    if len(h) >= SHINGLE:
        same = np.flatnonzero(w.row[SHINGLE - 1 :] == w.row[: len(h) - SHINGLE + 1])
        rows.append(w.row[same])
        out.append(combine([h[same + k] for k in range(SHINGLE)]))
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        if len(short):
            rows.append(short)
            out.append(combine([h[firsts[short] + j] for j in range(k)]))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def first_of_each(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), sorted by hash and then row."""
    order = np.lexsort((rows, hashes))
    r, h = rows[order], hashes[order]
    keep = np.ones(len(r), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[keep], h[keep]


def set_hashes(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row, a hash of its set of distinct hashes, as a signed 64-bit number."""
    out = np.zeros(n_rows, dtype=np.uint64)
    np.add.at(out, rows, mix64(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    return mix64(out).view(np.int64)
