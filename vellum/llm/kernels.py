"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 buffer of a whole Arrow batch at once: words are byte ranges, a word's
hash is a polynomial over its bytes, and the hash of a window of words comes from one prefix sum, so its cost
does not depend on the window's length.  Hashes are 64 bits wide; callers that need certainty compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; bounds the working memory to some 60 times this, or one text if that is longer.
CHUNK_BYTES = 2_000_000

U64 = np.uint64
_BYTE_STEP = 0x9E3779B97F4A7C15 | 1
_WORD_STEP = 0xD6E8FEB86659FD93 | 1
_tables: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(step: int, n: int) -> np.ndarray:
    """step ** i modulo 2 ** 64 for i below n, kept for the next call."""
    have = _tables.get(step)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), step % (1 << 64), dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _tables[step] = have
    return have[:n]


def _byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix64(np.arange(1, 257, dtype=U64) * U64(_BYTE_STEP))
    return _tables["bytes"]


def byte_class(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Words are what lies between the blanks 0x20 and 0x09 to 0x0D.
NOT_BLANK = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Words are digits, letters a to z (after lower-casing) and everything outside ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes of text, or of one row."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each range of rows."""
    buf, off = text_buffer(column)
    for a, b in row_chunks(off, limit):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


class Words:
    """The words of some texts: byte ranges start:end, and first[d]:first[d + 1] for the words of text d."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.buf, self.off = buf, off
        inside = self.inside = table[buf]
        n = len(buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = off[1:-1]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, U64)
        a, e = self.start[0], self.end[-1]
        rel = self.start - a
        place = np.arange(e - a) - np.repeat(rel, np.diff(np.append(rel, e - a)))
        value = _byte_values()[self.buf[a:e]]
        value *= _powers(_BYTE_STEP, int(place.max()) + 1)[place]
        value[~self.inside[a:e]] = 0
        return mix64(np.add.reduceat(value, rel) + (self.end - self.start).astype(U64) * U64(_WORD_STEP))

    def slice(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        raw = self.buf
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _powers(_WORD_STEP, len(h)), out=total[1:])
    out = total[k:] - total[:n]
    out *= _powers(pow(_WORD_STEP, -1, 1 << 64), n)
    return mix64(out + U64(k))


def within(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each place on lie in one text (for each place that window_hashes has)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(words.first[1:], words.count)
    return np.arange(n) + k <= end[:n]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in one of the ranges of `length` places."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, n), -1)
    return np.cumsum(step[:n]) > 0
