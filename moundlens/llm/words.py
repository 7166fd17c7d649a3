"""Words of many texts at once: byte offsets and 64-bit digests, computed on whole Arrow buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes handled at a time. A slice needs some 40 bytes of working memory per byte of text, so a
# text of any length is walked in bounded memory.
SLICE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _table(outside: bytes | range) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


# Both separator sets are ASCII, so testing bytes is testing code points: every byte of a longer
# UTF-8 sequence is 0x80 or above and belongs to a word.
NOT_BLANK = _table(b" \t\n\x0b\x0c\r")
ALPHANUMERIC = _table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """start, end: byte offsets of each word; digest: 64 bits; first: word offsets of the texts."""

    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, digests: bool = True) -> Words:
    """Maximal runs of bytes marked in `inside`, never across two texts."""
    starts, ends, hashes = [], [], []
    is_first = np.zeros(len(data) + 1, bool)
    is_first[offsets] = True
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        if hi < len(data):  # end the slice where a word ends
            tail = np.flatnonzero(~inside[data[lo:hi]])
            while not len(tail) and hi < len(data):
                step = min(hi + SLICE, len(data))
                tail = np.flatnonzero(~inside[data[hi:step]]) + (hi - lo)
                hi = step
            if len(tail) and hi < len(data):
                hi = lo + int(tail[-1]) + 1
        part = data[lo:hi]
        word = inside[part]
        edge = is_first[lo : hi + 1]
        before = np.empty(len(word), bool)
        before[0], before[1:] = False, word[:-1]
        after = np.empty(len(word), bool)
        after[-1], after[:-1] = False, word[1:]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        starts.append(start + lo)
        ends.append(end + lo)
        if digests:
            hashes.append(_digest(part, start, end))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(
        start,
        np.concatenate(ends) if ends else start,
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.searchsorted(start, offsets),
    )


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the life of the worker."""
    if not _TABLES or len(_TABLES[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _TABLES[:] = [powers(_BASE, n), powers(inverse, n)]
    return _TABLES


def _digest(part, start, end) -> np.ndarray:
    """Polynomial of the word's bytes: a difference of running sums, moved back to exponent zero."""
    up, down = _tables(max(len(part), SLICE))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def windows(digest: np.ndarray, size: int) -> np.ndarray:
    """Digest of digest[i : i + size] for every i; windows across texts are for the caller to drop."""
    n = len(digest) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _STEP + digest[k : k + n]
    return mix(total)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of `size` words fits into its text."""
    total = int(first[-1])
    fits = np.ones(max(total, 0), bool)
    counts = np.diff(first)
    for k in range(1, size):  # the last size - 1 words of a text start none
        at = first[1:] - k
        fits[at[(counts >= k)]] = False
    return np.flatnonzero(fits)


def spread(starts: np.ndarray, sizes: np.ndarray | int, total: int) -> np.ndarray:
    """Mask of the words covered by the windows at `starts`."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + sizes, total), -1)
    return np.cumsum(edge[:-1]) > 0
