"""Tokenised documents packed into sequences by best-two-fit (operator 10).

Documents are encoded once; longer ones are cut.  For packing only lengths
count, and there are at most ``limit`` different ones, so the plan is made on
a histogram: a bin is filled greedily with the longest pieces that fit, then
its smallest piece is replaced by two unpacked pieces that fill the widened
gap more tightly.  The same bin is repeated as often as its lengths last, so a
plan has a bounded number of bin kinds (below limit * ln(limit) + limit)
however large the corpus is.  Pieces find their place by their rank among the
pieces of equal length, counted block by block without a global sort.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import materialize, shuffle_width

LIMIT, END_ID = 2048, 0
PIECE = 1 << 20           # bytes of texts whose repeated words are encoded once
MEMO = 500_000            # words whose ids a worker remembers; a cache only
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict[str, "WordEncoder"] = {}


class Pool:
    """Lists of ids one after another in a growing array."""

    def __init__(self):
        self.values, self.bounds, self.lists = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), 0

    def extend(self, lists: list[list[int]]) -> int:
        """Append ``lists``; the number of the first of them."""
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ends = self.bounds[self.lists] + np.cumsum(sizes)
        end, first = int(ends[-1]), self.lists
        while end > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while first + len(lists) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.values[end - int(sizes.sum()): end] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum()))
        self.bounds[first + 1: first + 1 + len(lists)] = ends
        self.lists += len(lists)
        return first


class WordEncoder:
    """Ids of words by a tokenizer that treats white space as a bound and ignores case.

    Splitting at white space, and between an ASCII letter or digit and an
    ASCII punctuation mark after it, never crosses a pre-token, so a word's
    ids do not depend on its neighbours and equal words are encoded once.  The
    file's added tokens (<|endoftext|>) are cut out of the texts first, as the
    library does by default: each is one id, and a bound.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # for what lies between added tokens: a word in lower case must not become one
        added = self.tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if t.normalized or t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that are not plain contents: {odd}")
        self.added = {t.content.encode("utf-8"): i for i, t in added.items()}
        self.marks = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.clear()

    def clear(self):
        self.index, self.pool = {}, Pool()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, token offsets of the texts), without any end mark."""
        marks = self._marks(data, offsets)
        data = _LOWER[data]
        for m in marks:
            data[m.start(): m.end()] = 0x20
        w = A.Words(data, offsets, split=(_ALNUM, _PUNCT))
        one, which = A.distinct_spans(data, w.start, w.end)
        if len(self.index) > MEMO:
            self.clear()
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(w.start[one].tolist(), w.end[one].tolist())]
        known = list(map(self.index.get, words))
        fresh = [i for i, k in enumerate(known) if k is None]
        for a in range(0, len(fresh), 4096):
            part = fresh[a: a + 4096]
            made = self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)
            for k, i in enumerate(part, self.pool.extend([e.ids for e in made])):
                known[i] = self.index[words[i]] = k
        at = np.array(known, dtype=np.int64)
        start = self.pool.bounds[at]
        start, count = start[which], (self.pool.bounds[at + 1] - start)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        ids, first = self.pool.values[A.ranges(start, count)], total[w.first]
        if marks:
            at = np.array([m.start() for m in marks])
            ids = np.insert(ids, total[np.searchsorted(w.start, at)], [self.added[m[0]] for m in marks])
            first = first + np.searchsorted(at, offsets)
        return ids, first

    def _marks(self, data: np.ndarray, offsets: np.ndarray) -> list[re.Match]:
        """The added tokens of the texts, in order; none reaches over the end of a text."""
        raw = data.tobytes()
        if not any(x in raw for x in self.added):
            return []
        return [m for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in self.marks.finditer(raw, a, b)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            data, offsets = A.text_arrays(batch.column("text"))
            for a, b in A.pieces(offsets, PIECE):
                ids, first = words.ids(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                size = np.diff(first) + 1
                bounds = np.concatenate([[0], np.cumsum(size)])
                whole = np.full(bounds[-1], end_id, dtype="<u4")
                whole[A.ranges(bounds[:-1], size - 1)] = ids
                parts = -(-size // limit)
                text = np.repeat(np.arange(b - a), parts)
                piece = A.ranges(np.zeros(b - a, np.int64), parts)
                start = piece * limit
                length = np.minimum(size[text] - start, limit)
                lo = (bounds[:-1][text] + start).tolist()
                raw = memoryview(whole).cast("B")
                crc = [zlib.crc32(raw[4 * i: 4 * (i + n)]) for i, n in zip(lo, length.tolist())]
                columns = [batch.column("doc_id").take(pa.array(a + text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    at = np.append(np.cumsum(length) - length, length.sum()).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces of at most ``limit`` ids.

    A document's ids are those of its text, as the library gives them with
    add_special_tokens=False, and then ``end_id``; a null or empty text has
    ``end_id`` alone.  ``tokenizer``: path of the file on every
    worker.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pieces(tokenizer, limit, end_id, with_ids),
                           f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Plan:
    """Bins by kind: where the pieces of each length go, by their rank.

    Best-two-fit is planned twice, over all lengths at once and with pieces
    below ``limit`` / 6 held back for the gaps that the others leave; each way
    is also planned without the exchange of one piece for two (which leaves
    first-fit decreasing).  The plan with the fewest sequences counts, the
    first of equals.
    """

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit = limit
        left = np.zeros(limit + 2, dtype=np.int64)
        for length, n in counts.items():
            left[length] = n
        bins = min((self._bins(left, least, two) for least, two in ((0, True), (limit // 6, True), (0, False))), key=lambda b: sum(n for _, n in b))
        taken = np.zeros(limit + 2, dtype=np.int64)
        self.slots: dict[int, list[tuple[int, int, int]]] = {}   # length: first rank, first sequence, offset
        self.sequences = 0
        for kind, times in bins:
            offset = 0
            for s in kind:
                self.slots.setdefault(s, []).append((int(taken[s]), self.sequences, offset))
                taken[s] += times
                offset += s
            self.sequences += times

    def _bins(self, left: np.ndarray, least: int, two: bool) -> list[tuple[list[int], int]]:
        """(lengths of a sequence, how many such sequences): those above ``least`` first, the others into their gaps and then by themselves."""
        large, small = left.copy(), left.copy()
        large[: least + 1], small[least + 1:] = 0, 0
        bins = []
        for kind, times in self._filled(large, two):
            while times:
                extra = self._greedy(small, self.limit - sum(kind))
                n = self._spend(small, extra, times) if extra else times
                bins.append((kind + extra, n))
                times -= n
        return bins + self._filled(small, two)

    def _filled(self, left: np.ndarray, two: bool) -> list[tuple[list[int], int]]:
        bins = []
        while left.any():
            kind = self._greedy(left, self.limit)
            if two:
                kind = self._exchanged(left, kind)
            bins.append((kind, self._spend(left, kind, int(left.sum()))))
        return bins

    @staticmethod
    def _spend(left: np.ndarray, kind: list[int], most: int) -> int:
        """Take ``kind`` out of ``left`` as often as it is there, ``most`` times at most."""
        uses = Counter(kind)
        times = int(min(most, *(left[s] // k for s, k in uses.items())))
        for s, k in uses.items():
            left[s] -= times * k
        return times

    @staticmethod
    def _greedy(left: np.ndarray, gap: int) -> list[int]:
        """The largest length that fits, again and again."""
        have, kind = np.flatnonzero(left[: gap + 1]), []
        used: Counter[int] = Counter()
        while gap:
            have = have[: np.searchsorted(have, gap, side="right")]
            if not have.size:
                break
            s = int(have[-1])
            k = min(int(left[s]) - used[s], gap // s)
            kind += [s] * k
            used[s] += k
            gap -= s * k
            have = have[:-1]
        return kind

    def _exchanged(self, left: np.ndarray, kind: list[int]) -> list[int]:
        """``kind`` with its smallest piece replaced by two that fill more, as often as that can be done."""
        kind, free = list(kind), left.copy()
        for s in kind:
            free[s] -= 1
        gap = self.limit - sum(kind)
        while gap and kind:
            smallest = min(kind)
            pair = self._two(free, smallest, smallest + gap)
            if not pair:
                break
            kind.remove(smallest)
            free[smallest] += 1
            for s in pair:
                kind.append(s)
                free[s] -= 1
            gap += smallest - sum(pair)
        return sorted(kind, reverse=True)

    @staticmethod
    def _two(left: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is above ``least`` and as close to ``most`` as can be."""
        if not left.any():
            return None
        for total in range(min(most, 2 * (len(left) - 2)), least, -1):
            x = np.arange(max(1, total - len(left) + 2), total // 2 + 1)
            ok = (left[x] > 0) & (left[total - x] > 0)
            if total % 2 == 0 and x.size and x[-1] * 2 == total:
                ok[-1] = left[total // 2] > 1
            found = x[ok]
            if found.size:
                return int(found[-1]), int(total - found[-1])
        return None


def pack(pieces: DataFrame, limit: int = LIMIT, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` with sequence_id and offset: every row gets a place, without gaps, in sequences of at most ``limit``.

    Only the number of pieces of each length (at most ``limit`` numbers) comes
    to the driver.  ``length`` must lie in 1 .. limit; rows equal in all of
    ``order`` may swap their places.  An empty table gives an empty result.
    """
    wide = max(shuffle_width(pieces.sparkSession), 1)
    blocked = materialize(pieces.withColumn("__lane", F.pmod(F.xxhash64(*[c for c in order]), F.lit(wide)).cast("int")))
    counts = blocked.groupBy("__lane", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__lane", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    if any(not 1 <= length <= limit for length in histogram):
        raise ValueError(f"piece lengths must lie in 1 .. {limit}")
    plan = Plan(histogram, limit)
    slots = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in plan.slots.items()}
    ranked = (blocked.withColumn("__rank", F.row_number().over(Window.partitionBy("__lane", "length").orderBy(*order)) - 1)
              .join(starts, ["__lane", "length"])
              .select(*pieces.columns, (F.col("__rank") + F.col("__before")).alias("__rank")))

    names = list(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for a, b in zip(*A.runs_of(length[by])):
                rows = by[a:b]
                first, base, at = slots[int(length[rows[0]])]
                j = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[j] + rank[rows] - first[j], at[j]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType
    return ranked.mapInArrow(place, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
