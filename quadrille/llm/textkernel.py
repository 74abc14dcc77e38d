"""Vectorised word tables over Arrow text columns.

Two word classes are in use.  ``SPACE`` words are runs of anything but the
ASCII blanks 0x20 and 0x09-0x0D; ``ALNUM`` words are runs of digits, ASCII
letters and everything above 0x7F.  Both classes only look at ASCII, so they
can be cut on UTF-8 bytes: every byte of a multi-byte character is >= 0x80 and
belongs to a word.

A word is identified by a 64-bit polynomial hash of its bytes (after A-Z are
lower-cased).  With n different words in play the chance of any collision is
about n*n / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Odd multipliers by position inside a window.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(separators: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[separators] = False
    return table


SPACE = _class([0x20, *range(0x09, 0x0E)])
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _need(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n bytes."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverse", _BASE_INV)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                globals()[name] = np.cumprod(factors)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@dataclass
class Words:
    """Words of a run of documents: ``first[i]:first[i + 1]`` are those of document i."""

    hash: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Cut lower-cased texts into words of a class and hash them.

    A text longer than a few chunks is taken in pieces that end between words,
    so that the working memory follows the chunk and not the text.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    if n <= 2 * CHUNK_BYTES:
        begin, end, hashed, data = _cut_piece(data, offsets, table)
        return Words(hashed, np.searchsorted(begin, offsets), begin, end, data)
    parts, at = [], 0
    while at < n:
        to = min(at + CHUNK_BYTES, n)
        while to < n:
            gaps = np.flatnonzero(~table[data[to : to + 4096]])
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(to + 4096, n)
        inner = offsets[(offsets > at) & (offsets < to)] - at
        begin, end, hashed, low = _cut_piece(data[at:to], np.concatenate([[0], inner, [to - at]]), table)
        parts.append((begin + at, end + at, hashed, low))
        at = to
    begin, end, hashed, low = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(hashed, np.searchsorted(begin, offsets), begin, end, low)


def _cut_piece(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings, ends and hashes of the words, and the lower-cased bytes."""
    n = len(data)
    data = _LOWER[data]
    word = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = offsets[1:] - 1
    after[inner[inner >= 0]] = False
    begin = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    powers, inverse = _need(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:n], out=total[1:])
        hashed = mix((total[end] - total[begin]) * inverse[begin])
    return begin, end, hashed, data


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``size`` neighbours."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _PLACE[0]
        for k in range(1, size):
            out += hashes[k : k + n] * _PLACE[k]
        return mix(out + U64(size))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch holding about ``limit`` bytes of text, and never less than a row, with their bytes and offsets."""
    rows = batch.num_rows
    if not rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    data, offsets = text_buffers(column)
    at = 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    tidy()


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = None


def tidy() -> None:
    """Give memory that is no longer used back to the system; a worker process lives on for other tasks."""
    global _trim
    _trim = _trim or _trimmer()
    pa.default_memory_pool().release_unused()
    _trim(0)
