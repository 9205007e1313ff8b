"""Words of many texts as 64-bit hashes, straight from Arrow's bytes: no Python string is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose words are hashed with one run of powers, and bytes of texts that are looked at together.
BLOCK, PIECE = 1 << 19, 1 << 20

_SEED = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: Each byte's lower-cased self if it belongs to words (digits, letters, all beyond ASCII), else 0.
_LOW = np.zeros(256, dtype=np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _LOW[_a:_b] = np.arange(_a, _b)
_LOW[0x41:0x5B] = np.arange(0x61, 0x7B)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal, else unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers at least of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        up, down = (np.full(max(n, BLOCK + 1), b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def text_pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of a string or binary column, some rows at a time.

    A piece has one row, or at most `most` bytes. Nulls are empty. Bytes are views of the column."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lower-cased) of all rows, in order, and how many words each row has."""
    rows = len(offsets) - 1
    low = _LOW[data]
    inside = low > 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(first), dtype=np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(after, first[i] + BLOCK, side="right")))
        a, b = first[i], after[j - 1]
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(low[a:b] * up[: b - a], out=sums[1:])
        out[i:j] = (sums[after[i:j] - a] - sums[first[i:j] - a]) * down[first[i:j] - a]
        i = j
    out = mix(out + (after - first).astype(np.uint64) * _SEED)
    counts = np.diff(np.searchsorted(first, offsets)) if rows else np.zeros(0, dtype=np.int64)
    return out, counts


def shingles(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words (of all its words if they are fewer), and how many runs each row has."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[doc] - np.arange(len(hashes))  # words from here to the row's end
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(n):
        part = np.zeros(len(hashes), dtype=np.uint64)
        part[: max(0, len(hashes) - k)] = hashes[k:]
        part[left <= k] = np.uint64(k + 1)
        total = mix(total + part)
    whole = (left >= n) | (np.arange(len(hashes)) == (ends - lengths)[doc])
    return total[whole], np.bincount(doc[whole], minlength=len(lengths))


def counted(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct elements in ascending order, how many each row has, and how often each comes in its row."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((elements, doc))
    e, d = elements[order], doc[order]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return e[at], np.bincount(d[at], minlength=len(counts)), np.diff(np.append(at, len(e)))
