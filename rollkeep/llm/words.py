"""Words of Arrow text columns as numpy arrays.

Texts are handled as UTF-8 bytes. The word classes used here hold every byte from 0x80 up
either wholly or not at all, so that byte classes and code point classes agree.
Everything works on blocks of whole texts of about ``BLOCK`` bytes, which bounds memory
whatever the batch size; one text longer than that makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _byte_values() -> np.ndarray:
    """A 64-bit number for each byte value, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


VALUES = _byte_values()
#: Byte classes: everything but space and 0x09-0x0D; letters, digits and bytes from 0x80.
NOT_SPACE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_powers = np.ones(1, dtype=_U)
_inverse = np.ones(1, dtype=_U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            out.append(np.cumprod(p))
        if size > 4 * BLOCK:
            return out[0][:n], out[1][:n]  # too large to be worth keeping
        _powers, _inverse = out
    return _powers[:n], _inverse[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over ``values`` (uint64), for :func:`span_hash`."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal for equal content wherever it stands."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start])


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` consecutive values (len(a) - width + 1 of them)."""

    def joined(step: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = least[:upto], least[step : step + upto]
        return np.minimum(left, right), np.where(right < left, at[step : step + upto], at[:upto])

    done, least, at = 1, a, np.arange(len(a), dtype=np.int32)
    while done * 2 <= width:
        least, at = joined(done, len(at) - done)
        done *= 2
    return joined(width - done, len(at) - (width - done))[1] if width > done else at


@dataclass
class Block:
    """Some whole texts: ``data`` bytes, ``bounds`` (text i is data[bounds[i]:bounds[i+1]])
    and, for each word, start, end (byte positions) and text number; ``first`` holds for each
    text the number of its first word (one entry more than texts)."""

    offset: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        data = LOWER[self.data] if lower else self.data
        return span_hash(prefix_hash(VALUES[data]), self.start, self.end)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def split_words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text first word numbers of the maximal runs of word bytes."""
    inside = is_word[data]
    edge = np.empty(len(data), dtype=bool)
    edge[:1] = True
    edge[1:] = ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    edge[cuts] = True
    start = np.flatnonzero(inside & edge)
    edge[-1:] = True
    edge[:-1] = ~inside[1:]
    edge[cuts[cuts > 0] - 1] = True
    end = np.flatnonzero(inside & edge) + 1
    return start, end, np.searchsorted(start, bounds)


def blocks(column: pa.Array, is_word: np.ndarray, block: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts that cover the column in order, empty texts included."""
    data, bounds = text_bytes(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, side="right")) - 1)
        part, local = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        yield Block(i, part, local, *split_words(part, local, is_word))
        i = j


def anchors(hashes: np.ndarray, text: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the leftmost smallest k-gram of each window of ``span`` words of one text.

    Returns the windows (number of their first word), the first word of each window's
    k-gram, and the hashes of all k-grams by first word. Two windows with the same words
    choose the same k-gram, so a shared span of ``span`` words always shares one.
    """
    if len(hashes) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=_U)
    at = np.arange(len(hashes) - k + 1)
    grams = span_hash(prefix_hash(hashes), at, at + k)
    chosen = sliding_argmin(grams, span - k + 1).astype(np.int64)
    windows = np.flatnonzero(text[: len(text) - span + 1] == text[span - 1 :])
    return windows, chosen[windows], grams
