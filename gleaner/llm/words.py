"""Words and word shingles of Arrow text columns, hashed in bulk.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z.  Every function works on the
UTF-8 bytes of many rows at once, so a task's memory follows the slice size and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SHINGLE = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, (_, offsets, data) = len(texts), texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` in all; a longer row is a run of its own."""
    total, start = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            total, start = 0, i
        total += n
    if start < len(lengths):
        yield start, len(lengths)


class Words(NamedTuple):
    """Hashes of the words of some rows; row i has words[at[i]:at[i + 1]], at bytes start to end."""

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _sums(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial sums of the words of some rows, and where the words start and end."""
    n = len(data)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
    return (total[end] - total[start]) * inverse[start], start, end


def words(data: np.ndarray, at: np.ndarray) -> Words:
    """Long data goes in pieces, so that but for the words themselves memory follows SLICE_BYTES."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c in range(0, len(data), SLICE_BYTES):
        piece = data[c : c + SLICE_BYTES]
        own = at[np.searchsorted(at, c) : np.searchsorted(at, c + len(piece), "right")] - c
        total, start, end = _sums(piece, own)
        if found and len(start) and start[0] == 0 and found[-1][2][-1] == c and (len(own) == 0 or own[0] > 0):  # a word goes on
            held = found[-1]
            size = int(held[2][-1] - held[1][-1])
            held[0][-1:] += total[:1] * np.array([pow(_BASE, size, 1 << 64)], np.uint64)
            held[2][-1] = c + end[0]
            total, start, end = total[1:], start[1:], end[1:]
        if len(start):
            found.append((total, start + c, end + c))
    if not found:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none)
    total, start, end = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(mix(total + (end - start).astype(np.uint64)), np.searchsorted(start, at), start, end)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, row by row, and the row offsets.

    A row of fewer words gives its whole sequence as one; a row without words gives none.
    """
    counts = np.diff(w.at)
    n = len(w.hashes)
    short = (counts > 0) & (counts < size)
    sizes = np.where(short, 1, np.maximum(counts - size + 1, 0))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    factors = _BYTE[1 : size + 1] | np.uint64(1)
    out = np.zeros(out_at[-1], np.uint64)
    if n >= size:
        rolled = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            rolled += w.hashes[k : n - size + 1 + k] * factors[k]
        long = np.flatnonzero(counts >= size)
        keep = np.zeros(n + 1, np.int64)
        np.add.at(keep, w.at[long], 1)
        np.add.at(keep, w.at[long + 1] - size + 1, -1)
        place = np.zeros(out_at[-1] + 1, np.int64)
        np.add.at(place, out_at[long], 1)
        np.add.at(place, out_at[long + 1], -1)
        out[np.cumsum(place)[:-1] > 0] = mix(rolled[np.cumsum(keep)[: n - size + 1] > 0])
    for i in np.flatnonzero(short).tolist():
        own = w.hashes[w.at[i] : w.at[i + 1]]
        out[out_at[i]] = mix((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, out_at


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(shingles(words(data, np.array([0, len(data)])), size)[0])
