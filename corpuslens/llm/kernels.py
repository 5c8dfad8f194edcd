"""Vectorised text kernels over Arrow string columns: words, word hashes and shingle sets without per-word Python.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; letters A-Z count as a-z. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes handled at once. A longer text is a chunk by itself, but is hashed in pieces of this size: beside some five bytes of
#: memory for each of its bytes and 24 for each of its words, only a piece needs more.
CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Parts words at all ASCII bytes but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_P = np.uint64(0x9E3779B97F4A7C15)
#: So many bytes of a word are hashed eight at a time; longer words add sums over all their bytes.
SHORT = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            full = np.full(max(n, CHUNK + 1), p, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are those of text ``i`` of the chunk."""

    rows: range
    data: np.ndarray  #: lower-cased bytes
    offsets: np.ndarray  #: of each text in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of each word."""
        return span_hashes(self.data, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, and for each text where its runs begin (like ``first``)."""
        h, count = self.hashes, np.diff(self.first)
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
        text = np.repeat(np.arange(len(count)), count)
        inside = text[: len(h) - n + 1] == text[n - 1 :]
        return run_hashes(h, n)[inside], np.concatenate(([0], np.cumsum(np.maximum(count - n + 1, 0))))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    g = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        for k in range(n):
            g = g * _STEP + h[k : k + m]
        g = mix(g + np.uint64(n))
    return g


def chunks(column: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of runs of texts of about CHUNK bytes; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        to = min(to, len(column))
        yield range(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(column: pa.Array, space: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of a string column, chunk by chunk."""
    for rows, raw, offsets in chunks(column):
        yield words_of(rows, raw, offsets, space)


def words_of(rows: range, raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``; ``space`` says which bytes part words."""
    data = raw | (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))  # A-Z
    solid = (raw != 32) & ((raw - np.uint8(9)) > 4) if space is SPACE else ~space[raw]
    n = len(raw)
    # where words begin and end, in turn
    turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if n and solid[0]:
        turns = np.concatenate(([0], turns))
    if n and solid[-1]:
        turns = np.append(turns, n)
    starts, ends = turns[::2], turns[1::2]
    # a word that ends where the next text begins with one
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < n)]
    inner = inner[solid[inner] & solid[inner - 1]]
    if len(inner):
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return Words(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs starts..ends-1, in order and apart, equal for equal runs anywhere."""
    size = ends - starts
    out = size.astype(np.uint64) * _P
    if not len(data):
        return mix(out)
    # eight bytes at a time; those behind the run's end are masked
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out ^= eight[starts] & _MASKS[np.minimum(size, 8)]
    out *= _P
    some, at = np.flatnonzero(size > 8), 8
    while len(some):
        left = size[some] - at
        out[some] = (mix(out[some]) ^ eight[starts[some] + at] & _MASKS[np.minimum(left, 8)]) * _P
        at += 8
        some = some[(left > 8) & (at < SHORT)]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] ^= _long_hashes(data, starts[long], ends[long])
    return mix(out)


def _long_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of long runs, in pieces of CHUNK bytes."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        low, high = starts[at], ends[to - 1]
        if high - low <= CHUNK:
            out[at:to] = _span_sums(data[low:high], starts[at:to] - low, ends[at:to] - low)
        else:  # one run of more than CHUNK bytes: the sums of its pieces, each moved to its place
            places = range(low, high, CHUNK)
            sums = np.concatenate([_span_sums(data[a : min(a + CHUNK, high)], np.array([0]), np.array([min(CHUNK, high - a)])) for a in places])
            out[at] = (sums * np.array([pow(int(_P), int(a - low), 1 << 64) for a in places], np.uint64)).sum(dtype=np.uint64)
        at = to
    return out


def _span_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def shingle_sets(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one."""
    g, first = w.grams(n)
    for i in range(len(w.first) - 1):
        a, b = first[i], first[i + 1]
        if b > a:
            yield np.unique(g[a:b])
        else:
            h = w.hashes[w.first[i] : w.first[i + 1]]
            yield run_hashes(h, len(h)) if len(h) else h


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


class Spans:
    """Hashes of arbitrary runs of a chunk's words in constant time each, and of runs with one word left out."""

    def __init__(self, hashes: np.ndarray):
        self.power, self.inverse = _power(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[: len(hashes)], out=self.total[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a..b-1; equal for equal word sequences anywhere."""
        return mix(self.raw(a, b) + (b - a).astype(np.uint64) * _STEP)

    def without(self, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``of`` the sequence a..b-1 less word j."""
        left_out = self.raw(a, j) + self.raw(j + 1, b) * self.power[j - a]
        return mix(left_out + (b - a - 1).astype(np.uint64) * _STEP)
