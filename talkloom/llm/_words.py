"""Vectorised words and hashes over a batch's text buffer (numpy, no per-word Python)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Kinds of bytes: 0 space and control, 1 word, 2 punctuation.
_KINDS = np.array([0 if b < 33 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    size = 0
    up = down = np.zeros(0, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.size < n:
            cls.size = max(n, 1 << 20)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(pow(_BASE, -1, 1 << 64), cls.size)
        return cls.up, cls.down


@dataclass
class Words:
    """Words (runs of other bytes than space and 9 to 13) of several documents, in order."""

    hashes: np.ndarray  # 64-bit, of the word's bytes
    starts: np.ndarray  # byte positions in the buffer
    ends: np.ndarray
    first: np.ndarray  # per document the position of its first word; one more at the end
    buffer: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets, rebased to 0; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return buffer, offsets - offsets[0]


def _runs(buffer: np.ndarray, offsets: np.ndarray, kind: np.ndarray, codes: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind (0: none) within a document."""
    n = len(buffer)
    k = kind[buffer]
    new = np.ones(n + 1, bool)  # a boundary before position i
    new[1:n] = k[1:] != k[:-1]
    new[offsets] = True
    bounds = np.flatnonzero(new)
    starts, ends = bounds[:-1], bounds[1:]
    inside = k[starts] > 0
    starts, ends = starts[inside], ends[inside]
    up, down = _Tables.of(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(codes[buffer] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), buffer)


def words(column: pa.Array, lower: bool = True) -> Words:
    """The words of each text of a string array; A-Z are hashed as a-z if ``lower``."""
    return _runs(*text_buffer(column), (~_SPACE).astype(np.uint8), _LOWER if lower else _CODES)


def tokens(column: pa.Array) -> Words:
    """Runs of word bytes (letters, digits, bytes from 128) or of other printing bytes; case kept."""
    return _runs(*text_buffer(column), _KINDS, _CODES)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words and, per document, the position of its first window.

    A document with fewer words has one window, its whole sequence; one
    without words has none.
    """
    counts = np.diff(w.first)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(windows)])
    doc = np.repeat(np.arange(len(counts)), windows)
    first = w.first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    length = np.minimum(counts[doc], size)
    out = mix(length.astype(_U))
    padded = np.concatenate([w.hashes, np.zeros(size, _U)])
    for k in range(size):
        out = np.where(k < length, mix(out * _U(0xFF51AFD7ED558CCD) + padded[first + k]), out)
    return out, at


def sets(w: Words, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its windows."""
    hashes, at = shingles(w, size)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def compact(buffer: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer without the bytes that ``keep`` (by byte value) leaves out, and its offsets."""
    mask = keep[buffer]
    sums = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return buffer[mask], sums[offsets]
