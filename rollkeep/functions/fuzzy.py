"""Likeness of a short text to the best window of a longer one, for damaged labels and titles.

The likeness of two texts is twice the characters they share in order over the characters of
both, times 100. Windows are as long as the shorter text; at the ends of the longer one
they may be cut, as where a scan has lost the first letters of a label.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter labels are only found undamaged.
SHORTEST = 3
#: In longer lines characters and pairs are counted before windows are compared.
COUNTED = 64
#: So many characters of lines are counted together.
TOGETHER = 1 << 18


def _masks(text: str) -> dict[str, int]:
    """For each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(masks: dict[str, int], n: int, window: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given by its masks, and a window."""
    left = full = (1 << n) - 1  # bits of places not yet used
    for c in window:
        met = left & masks.get(c, 0)
        left = (left + met | left - met) & full
    return n - left.bit_count()


def _windows(n: int, text: str, letters: set[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of cut windows at the start, whole ones, and cut ones at the end.

    Windows that end (at the end of the text: begin) with a character the other text doesn't hold are
    left out: one that is moved or cut by a character is never less like it.
    """
    for end in range(1, n):
        if text[end - 1] in letters:
            yield 0, end
    for start in range(len(text) - n):
        if text[start + n - 1] in letters:
            yield start, start + n
    for start in range(len(text) - n, len(text)):
        if text[start] in letters:
            yield start, len(text)


@lru_cache(maxsize=256)
def _needs(short: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a text's characters by code point (others: 0), which pairs of numbers it holds, and how many of either a window of each length must hold to be so like it."""
    letters = sorted(set(short))
    number = np.zeros(ord(letters[-1]) + 2, dtype=np.int32)
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    pairs = np.zeros((len(letters) + 1) ** 2, dtype=bool)
    for a, b in grams(short):
        pairs[number[ord(a)] * (len(letters) + 1) + number[ord(b)]] = True
    n, length = len(short), range(len(short) + 1)
    common = [ceil(least * (n + m) / 200 - 1e-9) for m in length]
    kept = [len(grams(short)) - 2 * (n - c) - (m - c) if c <= m else n for m, c in zip(length, common, strict=True)]
    return number, pairs, np.array(common), np.array(kept)


def best_place(short: str, long: str, least: float = 0.0, windows: Iterable[tuple[int, int]] | None = None) -> tuple[int, int, float] | None:
    """(start, end, likeness) of the first best window of the longer text (of ``windows``); null under ``least`` or without a common character."""
    n, masks = len(short), _masks(short)
    best, place = least, None
    for start, end in _windows(n, long, set(masks)) if windows is None else windows:
        whole = n + end - start
        if 200.0 * min(n, end - start) / whole < best:
            continue
        likeness = 200.0 * _common(masks, n, long[start:end]) / whole
        if likeness >= best and (place is None or likeness > place[2]):
            best, place = likeness, (start, end, likeness)
    return place


def best_window(short: str, long: str) -> float:
    """100 times the likeness of the best window, whichever text is the shorter."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 100.0 if not long else 0.0
    place = best_place(short, long)
    return place[2] if place else 0.0


@F.pandas_udf(T.DoubleType())
def partial_ratio(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else best_window(a, b) for a, b in zip(short, long, strict=True)], dtype="float64")


def damaged_place(name: str, line: str, least: float) -> tuple[int, int, float] | None:
    """(start, length, likeness from 0 to 1) of the first best window of a line that is at least so like a name.

    A line shorter than the name is compared with the name's windows and counts whole.
    Texts whose characters alone can't reach the likeness aren't compared.
    """
    short, long = (name, line) if len(name) <= len(line) else (line, name)
    n = len(short)
    # Of n characters and a window of m, at most min(n, m) and at most the shared ones stand in both.
    shared = sum((Counter(short) & Counter(long)).values()) if n else 0
    if not n or 200.0 * shared < least * (n + min(n, shared)):
        return None
    place = best_place(short, long, least)
    if place is None:
        return None
    return (place[0], place[1] - place[0], place[2] / 100) if long is line else (0, len(line), place[2] / 100)


def lost_grams(n: int, least: float) -> int:
    """How many pairs of neighbouring characters a text of n may lose at most in a window that is at least so like it.

    A character that the window lacks takes two pairs at most, one that it adds parts one.
    """
    worst = 0
    for m in range(1, n + 1):
        common = ceil(least * (n + m) / 200 - 1e-9)
        if common <= m:
            worst = max(worst, 2 * (n - common) + (m - common))
    return worst


def grams(text: str) -> list[str]:
    """The different pairs of neighbouring characters."""
    return sorted({text[i : i + 2] for i in range(len(text) - 1)})


def likely_windows(name: str, lines: list[str], least: float) -> dict[int, list[tuple[int, int]]]:
    """By number of a line, none shorter than the name: those of :func:`_windows` with as many of the name's characters and pairs as one that is at least so like it keeps."""
    number, pairs, common, kept = _needs(name, least)
    n, gap = len(name), "\0" * len(name)
    # Between lines there is room for a window, so that none holds two lines and a cut one is a whole one that begins or ends there.
    sizes = np.array([len(x) for x in lines])
    end = np.cumsum(sizes + n)
    size = int(end[-1]) + n
    inside = np.zeros(size, dtype=np.int8)
    inside[end - sizes], inside[end] = 1, -1
    inside = np.cumsum(inside, dtype=np.int8)
    codes = np.frombuffer((gap + gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = number.take(np.minimum(codes, len(number) - 1)) * inside
    letters, chars, met = (np.zeros(size + 1, dtype=np.int32) for _ in range(3))
    np.cumsum(at > 0, out=letters[1:])
    np.cumsum(inside, out=chars[1:])
    np.cumsum(pairs.take(at[:-1] * (int(number.max()) + 1) + at[1:]), out=met[1:-1])
    length = chars[n:] - chars[:-n]
    fit = np.flatnonzero((letters[n:] - letters[:-n] >= common.take(length)) & (met[n - 1 : size] - met[: size - n + 1] >= kept.take(length)))
    line = np.searchsorted(end, fit, side="right")
    tail = fit >= end[line] - n
    good = at[np.where(tail, fit, fit + n - 1)] > 0
    fit, line = fit[good], line[good]
    first = end[line] - sizes[line]
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, lo, hi in zip(line.tolist(), np.maximum(fit - first, 0).tolist(), np.minimum(fit + n - first, sizes[line]).tolist(), strict=True):
        out[i].append((lo, hi))
    return out


def damaged_places(names: list[str], lines: list[str], least: list[float]) -> list[tuple[int, int, float] | None]:
    """:func:`damaged_place` of each; the characters and pairs of a name's longer lines are counted together, so that few windows are compared."""
    out: list[tuple[int, int, float] | None] = [None] * len(lines)
    alike = defaultdict(list)
    for i, (name, line, wanted) in enumerate(zip(names, lines, least, strict=True)):
        if name and wanted > 0 and len(line) > max(COUNTED, len(name)):
            alike[name, wanted].append(i)
        else:
            out[i] = damaged_place(name, line, wanted)
    for (name, wanted), rows in alike.items():
        parts = np.cumsum([len(lines[i]) + len(name) for i in rows]) // TOGETHER
        for part in np.split(np.array(rows), np.flatnonzero(np.diff(parts)) + 1):
            for k, windows in likely_windows(name, [lines[i] for i in part], wanted).items():
                place = best_place(name, lines[part[k]], wanted, windows)
                out[part[k]] = place and (place[0], place[1] - place[0], place[2] / 100)
    return out


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
def placed(name: pd.Series, line: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Where a line holds a damaged name (at from 1), or nulls."""
    found = damaged_places(name.tolist(), line.tolist(), least.tolist())
    rows = [(None, None, None) if p is None else (p[0] + 1, p[1], p[2]) for p in found]
    return pd.DataFrame(rows, columns=["at", "length", "ratio"]).astype({"at": "Int32", "length": "Int32", "ratio": "float64"})
