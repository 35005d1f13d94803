"""Byte-level BPE in two tiers (operator 6).

Pre-tokens that are in the vocabulary as a whole are found by a minimal
perfect hash (levels of bit arrays, the index is the number of bits before);
the others are merged pair by pair: those of up to ``SHORT`` bytes side by
side, a matrix of the parts of all that have the same number of parts left,
longer ones with a heap over linked bytes.  Texts are
first cut where a pre-token cannot cross (before white space that follows a
certain non-space), equal cuts of a piece are resolved once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import arrays as A

U = np.uint64
PIECE = 1 << 20           # bytes of texts whose repeated words are encoded once
SHORT = 64                # bytes of a pre-token up to which a round over all its pairs is cheaper than a heap
NONE = np.iinfo(np.int32).max
MEMO = 250_000            # cuts of texts whose ids a worker remembers; a cache only
_codecs: dict[tuple[str, str], "Codec"] = {}


class PerfectHash:
    """Index 0 .. n-1 of n distinct 64-bit keys, by levels: a key that meets another one goes to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels, used, left, self.values = [], 0, keys, []
        while len(left):
            size = max(64, 2 * len(left))
            at = self._slot(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, used + np.cumsum(alone) - alone))
            used += int(alone.sum())
            left = left[~alone[at]]
        self.stored = np.zeros(used, dtype=U)
        self.stored[self.index(keys)] = keys

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (A.mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for other keys some index or -1."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._slot(keys[open_], level, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key that is stored, else -1."""
        at = self.index(keys)
        return np.where((at >= 0) & (self.stored[at] == keys), at, -1)


class PairRanks:
    """The rank of the token that two tokens make together, by open addressing; ``NONE`` if they make none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.shift = U(64 - max(6, (4 * len(rank)).bit_length()))
        self.keys = np.zeros(1 << (64 - int(self.shift)), dtype=U)           # 0: free
        self.values = np.full(len(self.keys), NONE, dtype=np.int32)
        key, left_out = self._key(left, right), np.arange(len(rank))
        at = self._slot(key)
        while len(left_out):                         # of those that want a free slot one gets it, the others go on
            free = left_out[self.keys[at[left_out]] == 0]
            self.keys[at[free]] = key[free]
            got = free[self.keys[at[free]] == key[free]]
            self.values[at[got]] = rank[got]
            left_out = left_out[self.keys[at[left_out]] != key[left_out]]
            at[left_out] = (at[left_out] + 1) % len(self.keys)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(U) << U(32) | right.astype(U)) + U(1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (((key ^ (key >> U(29))) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.ranks = {t: i for i, t in tokens.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        halves = [(self.ranks.get(t[:k]), self.ranks.get(t[k:]), i) for t, i in self.ranks.items() for k in range(1, len(t))]
        self.pair = PairRanks(*np.array([h for h in halves if None not in h], dtype=np.int64).reshape(-1, 3).T)
        self.byte_pair = self.pair(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        size = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.token_bytes, self.token_end = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(size)
        self.token_size = size
        text = [b"%d " % i for i in range(len(self.tokens))]
        self.decimal_bytes, self.decimal_size = np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text], dtype=np.int64)
        self.decimal_end = np.cumsum(self.decimal_size)
        real = np.flatnonzero(size)
        keys = A.SpanHash(self.token_bytes)((self.token_end - size)[real], self.token_end[real])
        self.whole = PerfectHash(keys)
        self.rank_at = np.empty(len(real), dtype=np.int64)
        self.rank_at[self.whole.index(keys)] = real
        self.clear()

    def clear(self):
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def merge(self, token: bytes) -> tuple[int, ...]:
        """The pair of lowest rank first, the leftmost of equal ones: a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))                # of the part that begins at i; 0: no longer a part
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(token[i: i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or middle == stop or end[middle] != stop:
                continue                            # a part of the pair has changed
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(token[i: end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0:
                r = ranks.get(token[p: stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i: end[i]]])
            i = end[i]
        return tuple(out)

    def merge_short(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many pre-tokens side by side.

        In a round each one merges its pair of lowest rank (the leftmost), so
        each has one part less: all that have n parts, whatever they had at
        first, are the rows of one matrix.  Those without a pair are done.
        """
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        first, data = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        out: list[tuple[int, ...]] = [()] * len(tokens)
        n = int(size.max(initial=0))
        which, parts, ranks = np.zeros(0, np.int64), np.zeros((0, n), np.int32), np.zeros((0, max(n - 1, 0)), np.int32)
        for n in range(n, 0, -1):
            new = np.flatnonzero(size == n)
            own = data[first[new][:, None] + np.arange(n)]
            which, parts = np.concatenate([which, new]), np.concatenate([parts, self.byte_ids[own]])
            ranks = np.concatenate([ranks, self.byte_pair[own[:, :-1], own[:, 1:]]])
            row = np.arange(len(which))
            best = ranks.argmin(axis=1) if n > 1 else np.zeros(len(which), np.int64)
            low = ranks[row, best] if n > 1 else np.full(len(which), NONE)
            done = low == NONE
            for i, ids in zip(which[done].tolist(), parts[done].tolist()):
                out[i] = tuple(ids)
            if n == 1:
                break
            which, parts, ranks, best, low = (x[~done] for x in (which, parts, ranks, best, low))
            row = row[:len(which)]
            parts[row, best] = low
            held = np.ones(parts.shape, dtype=bool)
            held[row, best + 1] = False
            parts = parts[held].reshape(len(row), n - 1)
            held = np.ones(ranks.shape, dtype=bool)
            held[row, best] = False
            ranks = ranks[held].reshape(len(row), n - 2)
            r = np.flatnonzero(best > 0)
            ranks[r, best[r] - 1] = self.pair(parts[r, best[r] - 1], parts[r, best[r]])
            r = np.flatnonzero(best < n - 2)
            ranks[r, best[r]] = self.pair(parts[r, best[r]], parts[r, best[r] + 1])
        return out

    def learn(self, fresh: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens: first of all that the perfect hash finds, then of the misses by merging."""
        raw = [t.encode("utf-8") for t in fresh]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        end = np.cumsum(size)
        at = self.whole.find(A.SpanHash(np.frombuffer(b"".join(raw), np.uint8))(end - size, end))
        rank = np.where(at >= 0, self.rank_at[at], -1).tolist()
        known, short = {}, {}
        for t, r, i in zip(fresh, raw, rank):
            if i >= 0 and self.tokens[i] == r:
                known[t] = (i,)
            elif len(r) > SHORT:
                known[t] = self.merge(r)
            else:
                short[t] = r
        known.update(zip(short, self.merge_short(list(short.values()))))
        return known

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets of the texts)."""
        if len(self.memo) > MEMO:
            self.clear()
        start = cuts(data, offsets)
        end = np.append(start[1:], len(data))
        one, which = A.distinct_spans(data, start, end)
        raw, find, memo = data.tobytes(), self.pattern.findall, self.memo
        spans = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        new = [s for s in spans if s not in memo]
        parts = [find(s.decode("utf-8")) for s in new]
        known = self.learn(list({t for p in parts for t in p}))
        fresh = {s: known[p[0]] if len(p) == 1 else tuple([i for t in p for i in known[t]]) for s, p in zip(new, parts)}
        found = [fresh[s] if s in fresh else memo[s] for s in spans]
        memo.update((s, ids) for s, ids in fresh.items() if len(s) <= SHORT)
        count = np.array([len(ids) for ids in found], dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        first = np.cumsum(count) - count
        size = count[which]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids[A.ranges(first[which], size)], total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._spelled(ids, first, self.token_bytes, self.token_end, self.token_size)

    def decimals(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by a space."""
        return self._spelled(ids, first, self.decimal_bytes, self.decimal_end, self.decimal_size)

    @staticmethod
    def _spelled(ids, first, table, end, size):
        n = size[ids]
        return table[A.ranges((end - size)[ids], n)], np.concatenate([[0], np.cumsum(n)])[first]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of texts, and of white space right after a certain non-space.

    Certain are the printable ASCII characters and the characters of two bytes
    from U+00C0 on; no pre-token goes from a non-space to white space.
    """
    n = len(data)
    sure = (data > 0x20) & (data < 0x7F)
    sure[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    begin = np.zeros(n, dtype=bool)
    begin[1:] = A.SPACE[data[1:]] & sure[:-1]
    starts = offsets[:-1]
    begin[starts[starts < n]] = True
    return np.flatnonzero(begin)


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _encode(path: str, pattern: str, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            data, offsets = A.text_arrays(batch.column("text"))
            for a, b in A.pieces(offsets, PIECE):
                ids, first = c.encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                made = {"n_tokens": lambda: pa.array(np.diff(first)),
                        "ids": lambda: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)),
                        "ids_sha256": lambda: pa.array(_digests(*c.decimals(ids, first), drop=1)),
                        "decoded_sha256": lambda: pa.array(_digests(*c.decode(ids, first)))}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *[made[o]() for o in outputs]], names=["doc_id", *outputs])
    return run


def _digests(data: np.ndarray, first: np.ndarray, drop: int = 0) -> list[str]:
    view = memoryview(np.ascontiguousarray(data))
    at = first.tolist()
    return [sha256(view[a: max(a, b - drop)]).hexdigest() for a, b in zip(at[:-1], at[1:])]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``outputs`` of n_tokens, ids, ids_sha256, decoded_sha256, one row for each input row.

    ``ranks``: path of a tiktoken rank file on every worker.  Each match of
    ``pattern`` is encoded separately, without special tokens.  A null or empty
    text has no ids.  decoded_sha256 is the digest of the bytes that the ids
    decode to.  Other columns are not read; an empty table gives an empty result.
    """
    types = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_encode(ranks, pattern, tuple(outputs)), f"doc_id {kind}, " + ", ".join(f"{o} {types[o]}" for o in outputs))


def decode_ids(frame: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary): the bytes of each list of ids; a null list gives no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = c.decode(ids, first)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "decoded"])
    kind = frame.schema[id_col].dataType.simpleString()
    frame = frame.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return frame.mapInArrow(run, f"doc_id {kind}, decoded binary")
