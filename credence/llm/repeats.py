"""Exact removal of windows that also start in an earlier document, by request and response.

Shared frame of the word and the byte operator; they differ in the unit and in
how a bucket matches its segments.  ``window`` consecutive units are a window;
its key is the smallest hash of its ``gram``-unit grams (winnowing: equal
windows have equal keys, wherever they stand).  Consecutive windows of one key
form a segment.  Five steps, each a Spark shuffle between blocks (hash groups
of documents, about 4 MB) and buckets (hash groups of keys):

1. a block sends each of its distinct keys once, noting whether two of its
   documents have it;
2. a bucket answers which keys two documents have, to the blocks that asked;
3. a block sends each distinct segment of those keys once, with the smallest
   and largest doc_id that hold it;
4. a bucket matches its segments: for each window of each segment the smallest
   doc_id that has the window, answered to the blocks that need it;
5. a block removes the units covered by windows with an answer below the
   document's own doc_id.

A passage copied into many different surroundings gives as many distinct
segments of one key.  Blocks therefore tell in step 1 how many distinct
segments they have of each key, in ordinary ones: a gram stands in at most
``window - gram + 1`` windows, but where it recurs (one word or line repeated
over and over) a segment is as long as the text and counts as often as its
windows make up ordinary segments, since what matching takes grows with the
windows.  A key with more than ``HOT`` is answered as
hot in step 2, and its windows are sent one by one in step 3, each distinct
window of a block once, to buckets by the digest of the window.  (Sent as
texts to be matched like segments, the windows of op2 took more than 3000 MB
of an executor in the check; a digest takes 8 bytes.)

Whatever is frequent (a passage in a third of all documents) is sent once for
each block, so no group grows with the number of its copies in a block, and no
pairs are made.  The documents are shuffled once; the three uses share the
exchange.  Keys have 48 and digests 64 bits and are compared within one bucket
only; the matching of segments itself compares units, windows of hot keys are
told apart by their digests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import block_count

U = np.uint64
LAST_ID = np.iinfo(np.int64).max        # stands for a null doc_id: after all others
BLOCK, BUCKET = "__block", "__bucket"
HOT = 2000                              # distinct ordinary segments of a key, added up over blocks, that one bucket matches together


class Units:
    """Words or bytes of some texts as 64-bit symbols, and where they lie."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray):
        self.data, self.words = data, None
        if kind == "byte":
            self.symbol, self.first = A.byte_symbols(data), offsets
            self.digest = A.SpanHash(data)
        else:
            self.words = A.Words(data, offsets)
            self.symbol, self.first = self.words.symbol, self.words.first
            self.digest = A.SpanHash(self.symbol)

    def byte_span(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the units [start, end)."""
        return (start, end) if self.words is None else (self.words.start[start], self.words.end[end - 1])


def gram_keys(symbols: np.ndarray, gram: int) -> np.ndarray:
    return A.gram_hash(symbols, gram)


def key_of(smallest: np.ndarray) -> np.ndarray:
    """Minima crowd near zero; mixed again they spread over the buckets.  48 bits, the upper ones: two keys that
    are equal by chance only cost a comparison."""
    return A.mix(smallest ^ U(0xA5A5A5A5A5A5A5A5)) & ~U(0xFFFF)


KEY_BYTES = 6


def _sent_keys(key: np.ndarray) -> np.ndarray:
    """Six bytes of each key."""
    return np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:].ravel()


def _got_keys(column) -> np.ndarray:
    six = _join(column, np.uint8).reshape(-1, KEY_BYTES)
    key = np.zeros((len(six), 8), dtype=np.uint8)
    key[:, 2:] = six
    return key.view("<u8").ravel().astype(U)


def segments(u: Units, window: int, gram: int):
    """(text index, first unit, number of windows, key) of every segment."""
    counts = np.maximum(np.diff(u.first) - window + 1, 0)
    at = A.ranges(u.first[:-1], counts)
    if not len(at):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U)
    smallest = A.sliding_min(gram_keys(u.symbol, gram), window - gram + 1)[at]
    text = np.repeat(np.arange(len(counts)), counts)
    start, end = A.runs_of(smallest, text)
    return text[start], at[start], end - start, key_of(smallest[start])


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> U(24)) % U(n)).astype(np.int32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST_ID).to_numpy()


def _sorted_text(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = A.text_arrays(table.column("text"))
    return data, offsets, _ids(table.column("doc_id"))


def _cells(column) -> list[bytes]:
    return [x.as_buffer() for x in pa.chunked_array(column).combine_chunks()] if len(column) else []


def _join(column, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype=dtype) for b in _cells(column)] or [np.zeros(0, dtype)])


def _sizes(column, itemsize: int) -> np.ndarray:
    return np.array([len(b) // itemsize for b in _cells(column)], dtype=np.int64)


def _split(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def repeated_windows(docs: DataFrame, unit: str, window: int, gram: int, match: Callable,
                     finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Run the five steps.

    ``match(body, offsets, low)`` gets the distinct segments of a bucket
    (their bytes) and returns, for all windows of all segments in order, the
    smallest doc_id holding the window.  ``finish(units, offsets, removed)``
    gets some texts and the mask of removed units and returns the result
    columns named in ``schema`` as Arrow arrays.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"keep_{c}") for c in keep if c != text_col])
    held = {c: "text" if c == text_col else f"keep_{c}" for c in keep}
    n = block_count(base)
    base = base.withColumn(BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))     # null ids and rows of one id spread, too
    blocks = base.groupBy(BLOCK)

    def distinct_keys(table: pa.Table) -> pa.Table:
        block = table.column(BLOCK)[0].as_py()
        data, offsets, ids = _sorted_text(table)
        keys, owner, segs, loads = [], [], [], []
        for a, b in A.pieces(offsets):
            u = Units(unit, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            text, first, windows, key = segments(u, window, gram)
            keys.append(key)
            owner.append(ids[a + text])
            segs.append(u.digest(first, first + windows + window - 1))
            loads.append(-(-windows // (window - gram + 1)))     # 1, but for periodic texts
        key, owner, seg, load = (np.concatenate(x) for x in (keys, owner, segs, loads))
        order = np.lexsort((seg, key))
        key, owner, seg, load = key[order], owner[order], seg[order], load[order]
        start, _ = A.runs_of(key)
        if len(key):
            multi = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
            new = np.append(True, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]))
            count = np.add.reduceat(np.where(new, load, 0), start).astype(np.int32)
            key = key[start]
        else:
            multi, count = np.zeros(0, bool), np.zeros(0, np.int32)
        bucket = _buckets(key, n)
        order = np.argsort(bucket, kind="stable")
        key, multi, count, bucket = key[order], multi[order], count[order], bucket[order]
        s, e = A.runs_of(bucket)
        cuts = np.append(s, len(bucket))
        return pa.table({BUCKET: pa.array(bucket[s], pa.int32()), BLOCK: pa.array(np.full(len(s), block, np.int32)),
                         "key": pa.array(_split(_sent_keys(key), cuts * KEY_BYTES), pa.binary()), "multi": pa.array(_split(multi.astype(np.uint8), cuts), pa.binary()),
                         "count": pa.array(_split(count, cuts), pa.binary())})

    def shared_keys(table: pa.Table) -> pa.Table:
        size = _sizes(table.column("key"), KEY_BYTES)
        key, multi, count = _got_keys(table.column("key")), _join(table.column("multi"), np.uint8).astype(bool), _join(table.column("count"), np.int32)
        order = np.argsort(key, kind="stable")
        start, end = A.runs_of(key[order])
        hit, hot = np.zeros((2, len(key)), dtype=bool)
        if len(key):
            several = (end - start > 1) | (np.maximum.reduceat(multi[order], start))
            hit[order] = np.repeat(several, end - start)
            hot[order] = np.repeat(np.add.reduceat(count[order], start, dtype=np.int64) > HOT, end - start)
        cuts = np.concatenate([[0], np.cumsum(size)])
        found = [_sent_keys(key[a:b][hit[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        many = [hot[a:b][hit[a:b]].astype(np.uint8).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({BLOCK: table.column(BLOCK).cast(pa.int32()), "key": pa.array(found, pa.binary()), "hot": pa.array(many, pa.binary())}).filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    def distinct_segments(docs_: pa.Table, shared: pa.Table) -> pa.Table:
        names = (BUCKET, BLOCK, "low", "high", "size", "body", "window")
        wanted = _got_keys(shared.column("key")) if shared.num_rows else np.zeros(0, U)
        if not docs_.num_rows or not len(wanted):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 5)], names=names)
        wanted, at = np.unique(wanted, return_index=True)
        hot = _join(shared.column("hot"), np.uint8).astype(bool)[at]
        block = docs_.column(BLOCK)[0].as_py()
        data, offsets, ids = _sorted_text(docs_)
        got, single = [], []
        for a, b in A.pieces(offsets):
            u = Units(unit, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            text, first, windows, key = segments(u, window, gram)
            place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            pick = wanted[place] == key
            many = pick & hot[place]
            at = A.ranges(first[many], windows[many])
            single.append(_lowest(A.gram_hash(u.symbol, window)[at] if len(at) else np.zeros(0, U), *[ids[a + np.repeat(text[many], windows[many])]] * 2))
            pick &= ~many
            text, first, windows, key = text[pick], first[pick], windows[pick], key[pick]
            end = first + windows + window - 1
            seg = u.digest(first, end)
            s, e = u.byte_span(first, end)
            got.append((seg, key, ids[a + text], s + offsets[a], e + offsets[a]))
        seg, key, owner, s, e = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(seg, kind="stable")
        start, _ = A.runs_of(seg[order])
        one = order[start]
        low, high = ((f.reduceat(owner[order], start) if len(start) else owner) for f in (np.minimum, np.maximum))
        bucket = _buckets(key[one], n)
        order = np.argsort(bucket, kind="stable")
        one, low, high, bucket = one[order], low[order], high[order], bucket[order]
        size = e[one] - s[one]
        body = data[A.ranges(s[one], size)]
        if unit == "word":
            body[A.SPACE[body]] = 0x20
        bs, _ = A.runs_of(bucket)
        cuts = np.append(bs, len(bucket))
        bytes_at = np.concatenate([[0], np.cumsum(size)])[cuts]
        columns = [_split(x, cuts) for x in (low, high, size.astype(np.int32))] + [_split(body, bytes_at), [None] * len(bs)]
        digest, low, high = _lowest(*(np.concatenate(x) for x in zip(*single)))
        of = _buckets(digest, n)
        order = np.argsort(of, kind="stable")
        digest, low, high, of = digest[order], low[order], high[order], of[order]
        ws, _ = A.runs_of(of)
        cuts = np.append(ws, len(of))
        for c, more in zip(columns, (_split(low, cuts), _split(high, cuts), [None] * len(ws), [None] * len(ws), _split(digest, cuts))):
            c += more
        bucket = np.append(bucket[bs], of[ws])
        return pa.table([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), block, np.int32)), *[pa.array(c, pa.binary()) for c in columns]], names=names)

    def matched(table: pa.Table) -> pa.Table:
        whole = table.column("window").is_null()
        parts = [f(t) for f, t in ((matched_segments, table.filter(whole)), (matched_windows, table.filter(pc.invert(whole)))) if t.num_rows]
        return pa.concat_tables(parts)

    def matched_windows(table: pa.Table) -> pa.Table:
        """The smallest doc_id of each window of hot keys."""
        per_block = _sizes(table.column("low"), 8)
        digest, low, high = (_join(table.column(c), t) for c, t in (("window", U), ("low", np.int64), ("high", np.int64)))
        found, smallest, _ = _lowest(digest, low, high)
        value = smallest[np.searchsorted(found, digest)]
        cuts, need = np.concatenate([[0], np.cumsum(per_block)]), value < high
        spans = list(zip(cuts[:-1], cuts[1:]))
        sent_ = {"window": [digest[a:b][need[a:b]].tobytes() for a, b in spans], "value": [value[a:b][need[a:b]].tobytes() for a, b in spans]}
        none = pa.nulls(len(spans), pa.binary())
        out = pa.table([table.column(BLOCK).cast(pa.int32()), none, none, pa.array(sent_["value"], pa.binary()), none, pa.array(sent_["window"], pa.binary())],
                       names=[BLOCK, "seg", "runs", "value", "length", "window"])
        return out.filter(pa.array([len(x) > 0 for x in sent_["window"]], pa.bool_()))

    def matched_segments(table: pa.Table) -> pa.Table:
        per_block = _sizes(table.column("low"), 8)
        low, high, size = (_join(table.column(c), t) for c, t in (("low", np.int64), ("high", np.int64), ("size", np.int32)))
        body = _join(table.column("body"), np.uint8)
        at = np.cumsum(size, dtype=np.int64) - size
        seg = digests(unit, body, np.append(at, len(body)))
        order = np.argsort(seg, kind="stable")
        start, end = A.runs_of(seg[order])
        one = order[start]
        which = np.empty(len(seg), dtype=np.int64)          # request -> distinct segment
        which[order] = np.repeat(np.arange(len(start)), end - start)
        lowest = np.minimum.reduceat(low[order], start)
        offsets = np.concatenate([[0], np.cumsum(size[one], dtype=np.int64)])
        body = body[A.ranges(at[one], size[one].astype(np.int64))]
        of, least = match(body, offsets, lowest)   # distinct segment and answer of every window
        rs, re_ = A.runs_of(of, least)
        value, length, of = least[rs], (re_ - rs).astype(np.int32), of[rs]
        first = np.searchsorted(of, np.arange(len(one) + 1))
        runs = np.diff(first)
        smallest = np.minimum.reduceat(value, first[:-1])    # every segment has a window
        out = {c: [] for c in (BLOCK, "seg", "runs", "value", "length")}
        blocks_ = table.column(BLOCK).to_pylist()
        cuts = np.concatenate([[0], np.cumsum(per_block)])
        for block, a, b in zip(blocks_, cuts[:-1], cuts[1:]):
            w = which[a:b]
            need = smallest[w] < high[a:b]
            w = w[need]
            if len(w):
                pick = A.ranges(first[w], runs[w])
                for c, v in ((BLOCK, block), ("seg", seg[a:b][need].tobytes()), ("runs", runs[w].astype(np.int32).tobytes()), ("value", value[pick].tobytes()), ("length", length[pick].tobytes())):
                    out[c].append(v)
        return pa.table([pa.array(out[BLOCK], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("seg", "runs", "value", "length")], pa.nulls(len(out[BLOCK]), pa.binary())], names=[*out, "window"])

    def removed(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets, ids = _sorted_text(docs_)
        whole = answers.column("window").is_null()
        singles, answers = answers.filter(pc.invert(whole)), answers.filter(whole)
        single, lowest = _join(singles.column("window"), U), _join(singles.column("value"), np.int64)
        order = np.argsort(single, kind="stable")
        single, lowest = single[order], lowest[order]
        marked = np.zeros(1 << 20, dtype=bool)
        marked[(single >> U(8)) & U(len(marked) - 1)] = True
        seg, runs, value, length = (_join(answers.column(c), t) for c, t in (("seg", U), ("runs", np.int32), ("value", np.int64), ("length", np.int32)))
        order = np.argsort(seg, kind="stable")
        sorted_seg, first_run = seg[order], (np.cumsum(runs, dtype=np.int64) - runs)[order]
        runs, skip = runs[order].astype(np.int64), (np.cumsum(length, dtype=np.int64) - length)
        parts = []
        for a, b in A.pieces(offsets):
            u = Units(unit, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            mask = np.zeros(len(u.symbol), dtype=bool)
            if len(single):
                count = np.maximum(np.diff(u.first) - window + 1, 0)
                start, text = A.ranges(u.first[:-1], count), np.repeat(np.arange(len(count)), count)
                own = A.gram_hash(u.symbol, window)[start] if len(start) else np.zeros(0, U)
                likely = np.flatnonzero(marked[(own >> U(8)) & U(len(marked) - 1)])        # few windows are in hot keys
                start, text, own = start[likely], text[likely], own[likely]
                j = np.minimum(np.searchsorted(single, own), len(single) - 1)
                start = start[(single[j] == own) & (lowest[j] < ids[a + text])]
                mask = A.covered(start, start + window, len(u.symbol))
            if len(seg):
                text, first, windows, _ = segments(u, window, gram)
                own = u.digest(first, first + windows + window - 1)
                j = np.minimum(np.searchsorted(sorted_seg, own), len(sorted_seg) - 1)
                hit = np.flatnonzero(sorted_seg[j] == own)
                j = j[hit]
                pick = A.ranges(first_run[j], runs[j])
                occ = np.repeat(hit, runs[j])
                start = first[occ] + skip[pick] - np.repeat(skip[first_run[j]], runs[j])
                earlier = value[pick] < ids[a + text[occ]]
                start, count = start[earlier], length[pick][earlier]
                mask |= A.covered(start, start + count + window - 1, len(u.symbol))
            parts.append(finish(u, offsets[a: b + 1] - offsets[a], mask))
        if not docs_.num_rows:
            return result_type.empty_table()
        columns = {"doc_id": docs_.column("doc_id"), **{c: docs_.column(h) for c, h in held.items()}}
        columns |= {c: pa.chunked_array([p[c] for p in parts]) for c in parts[0]}
        return pa.table([columns[f.name].cast(f.type) for f in result_type], schema=result_type)

    from pyspark.sql.pandas.types import to_arrow_schema
    kept_types = "".join(f", `{c}` {base.schema[h].dataType.simpleString()}" for c, h in held.items())
    result_schema = f"doc_id long{kept_types}, {schema}"
    result_type = to_arrow_schema(spark.createDataFrame([], result_schema).schema)
    asked = blocks.applyInArrow(distinct_keys, f"{BUCKET} int, {BLOCK} int, key binary, multi binary, count binary")
    shared = asked.groupBy(BUCKET).applyInArrow(shared_keys, f"{BLOCK} int, key binary, hot binary")
    sent = (blocks.cogroup(shared.groupBy(BLOCK))
            .applyInArrow(distinct_segments, f"{BUCKET} int, {BLOCK} int, low binary, high binary, size binary, body binary, window binary"))
    answers = sent.groupBy(BUCKET).applyInArrow(matched, f"{BLOCK} int, seg binary, runs binary, value binary, length binary, window binary")
    return blocks.cogroup(answers.groupBy(BLOCK)).applyInArrow(removed, result_schema)


def _lowest(digest: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests in order, with the smallest ``low`` and the largest ``high`` of each."""
    order = np.argsort(digest, kind="stable")
    digest, low, high = digest[order], low[order], high[order]
    start, _ = A.runs_of(digest)
    return (digest[start], np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)) if len(start) else (digest, low, high)


def digests(unit: str, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The digest of each segment's units, as its block computed it."""
    out = []
    for a, b in A.pieces(offsets):
        u = Units(unit, body[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
        out.append(u.digest(u.first[:-1], u.first[1:]))
    return np.concatenate(out or [np.zeros(0, U)])


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow binary array from bytes and the end of every cell."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def count_by_text(first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marked units of each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
