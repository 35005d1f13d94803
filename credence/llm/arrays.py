"""Whole Arrow batches of texts as flat numpy arrays: words, rolling hashes, sliding minima.

A batch of texts is one byte array plus the start offset of every text.  All
functions work on the flat array at once, so no Python code runs per word.
Texts are processed in pieces of ``PIECE_BYTES`` (a piece always holds whole
texts), which bounds the memory of a task whatever the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 18          # temporaries of a few MB stay in a core's cache

_BASE = U(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class SpanHash:
    """64-bit hashes of any spans of one array, of bytes or of 64-bit symbols.

    Eight bytes (one symbol) a round enter a chain that is mixed after each, so
    no sum or product of positions can cancel, as it can in polynomials modulo
    a power of two.  All spans go on together, the shorter ones drop out;
    spans of more than ``LONG`` rounds are hashed whole by BLAKE2.
    """

    LONG = 64

    def __init__(self, symbols: np.ndarray):
        self._symbols = symbols
        self._width = 8 if symbols.dtype == np.uint8 else 1
        if self._width == 8:
            padded = np.append(symbols, np.zeros(8, np.uint8))
            self._lanes = np.lib.stride_tricks.as_strided(padded, (len(symbols) + 1, 8), (1, 1))

    def _lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        if self._width == 1:
            return self._symbols[at]
        lane = np.ascontiguousarray(self._lanes[at]).view("<u8").ravel()
        short = left < 8
        lane[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        return lane

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(1))
        for i in np.flatnonzero(size > self.LONG * self._width).tolist():
            h[i] = int.from_bytes(blake2b(self._symbols[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
        at = np.flatnonzero((size > 0) & (size <= self.LONG * self._width))
        place, left, x = start[at], size[at], h[at]
        while len(at):
            x ^= self._lane(place, left)
            x *= _BASE
            x ^= x >> U(32)                      # what a product keeps in its high half enters the next round
            on = left > self._width
            if not on.all():
                h[at[~on]] = x[~on]
                at, place, left, x = at[on], place[on], left[on], x[on]
            place = place + self._width
            left = left - self._width
        return mix(h)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each content, number of its content for every span); contents are compared, not only hashes."""
    spans = SpanHash(data)
    _, one, which = np.unique(spans(start, end), return_index=True, return_inverse=True)
    size, first = end - start, start[one][which]
    other = size != size[one][which]
    for i in np.flatnonzero((size > 8 * SpanHash.LONG) & (start != first) & ~other).tolist():
        other[i] = data[start[i]: end[i]].tobytes() != data[first[i]: first[i] + size[i]].tobytes()
    at = np.flatnonzero((size <= 8 * SpanHash.LONG) & (size > 0) & (start != first) & ~other)
    mine, its, left = start[at], first[at], size[at]
    while len(at):                               # eight bytes a round
        other[at[spans._lane(mine, left) != spans._lane(its, left)]] = True
        on = left > 8
        at, mine, its, left = at[on], mine[on] + 8, its[on] + 8, left[on] - 8
    if other.any():                              # hashes that are equal by chance
        raw, known, extra = data.tobytes(), {}, []
        which = which.copy()
        for i in np.flatnonzero(other).tolist():
            text = raw[start[i]: end[i]]
            if text not in known:
                known[text] = len(one) + len(extra)
                extra.append(i)
            which[i] = known[text]
        one = np.append(one, extra)
    return one, which


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    if len(offsets) < len(column) + 1:
        offsets = np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive text ranges [a, b) of about ``size`` bytes, at least one text each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts.

    ``start``/``end``: byte spans; ``first``: index of each text's first word
    (one more entry than texts); ``symbol``: a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: tuple[np.ndarray, np.ndarray] | None = None):
        n = len(data)
        solid = np.empty(n + 2, dtype=bool)
        solid[0] = solid[-1] = False
        np.logical_not(SPACE[data], out=solid[1:-1])
        begins, ends = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
        begins, ends = begins[:n], ends[1:]          # at the first byte; at the last byte
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        if len(cut):
            joined = solid[cut] & solid[cut + 1]     # bytes cut-1 and cut
            ends[cut[joined] - 1] = True
            begins[cut[joined]] = True
        if split is not None and n:                  # also between a byte of split[0] and one of split[1]
            at = np.flatnonzero(split[0][data[:-1]] & split[1][data[1:]])
            ends[at] = True
            begins[at + 1] = True
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = SpanHash(self.data)(self.start, self.end)
        return self._symbol


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive symbols (len - k + 1 of them), by doubling; the fold after each product keeps sums from cancelling."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out, done, part, size, base = None, 0, symbols, 1, int(_BASE)
    while size <= k:
        if k & size:
            out = part[:n] if out is None else out * U(base) + part[done: done + n]
            done += size
        if 2 * size <= k:
            part = part[:-size] * U(base) + part[size:]
            part ^= part >> U(32)
        base = base * base % (1 << 64)
        size *= 2
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of equal consecutive values (in every column)."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], n)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+count[0]-1, start[1] .. concatenated."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - start, count)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions 0 .. n-1 that lie in at least one [start, end)."""
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
