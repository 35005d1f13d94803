"""Byte-level de-duplication by merging Burrows-Wheeler transforms (operator 5).

The segments of a bucket are cut into shards.  Each shard gets its own suffix
order and its own transform, here of order three: the three bytes before a
suffix are one symbol, so one pass moves three bytes.  The shards are then merged by
refining an interleave (which shard does the i-th suffix come from): reading
the symbols in the present order and dealing the entries out by symbol gives
the order by three more bytes, and no suffixes are sorted again.  Two
neighbours stay in one interval only while they had the same symbol and came
from one interval, so after the passes that make up ``window`` bytes the intervals are exactly the
suffixes that share ``window`` bytes: their common prefix is at least that
long.  A pass carries only the suffixes from which a window's start is still
reached.  The smallest doc_id of an interval answers all its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm import arrays as A
from credence.llm.repeats import LAST_ID, Units, binary_column, count_by_text, repeated_windows

WINDOW, GRAM = 50, 18
STEPS = 3                                # bytes moved by one pass
SHARD_BYTES = 1 << 16
GROUP_BYTES = 1 << 18                    # segments merged at once; a key's segments are never parted


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of a shard in the order of at least ``depth`` bytes from them on; equal ones by place.

    Bytes after a segment's end count like others: what is read of the order
    never depends on them.  Prefix doubling from eight bytes; each round sorts
    only the places that still share their rank.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    packed = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(packed)
    rank = np.empty(n + 1, dtype=np.int64)              # first place of the suffixes that share it; of the end: before all
    rank[n] = -1
    start, end = A.runs_of(packed[order])
    rank[order] = np.repeat(start, end - start)
    h = 8
    while True:
        slots = np.flatnonzero(np.repeat(end - start > 1, end - start))
        if not len(slots):
            return order
        at = order[slots]
        if h >= depth:
            order[slots] = at[np.lexsort((at, rank[at]))]
            return order
        after = rank[np.minimum(at + h, n)]
        by = np.argsort(rank[at] * (n + 1) + after)
        at, after = at[by], after[by]
        order[slots] = at
        s, e = A.runs_of(rank[at], after)
        rank[at] = np.repeat(slots[s], e - s)
        start, end = _place_runs(n, slots, s, e)
        h *= 2


def _place_runs(n: int, slots: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs over all places: those of the sorted slots, every other place alone."""
    alone = np.ones(n + 1, dtype=bool)
    alone[slots] = False
    alone[slots[s]] = True
    start = np.flatnonzero(alone[:n])
    return start, np.append(start[1:], n)


def _before(codes: np.ndarray, steps: int) -> np.ndarray:
    """The ``steps`` symbols before each place as one symbol."""
    radix = int(codes.max(initial=0)) + 1
    value = np.zeros(len(codes), dtype=np.int64)
    for j in range(steps):
        value[steps:] = value[steps:] * radix + codes[j: len(codes) - steps + j]
    top = radix ** steps
    if top >= 1 << 16:                                  # dense numbers: few of the possible symbols occur
        number = np.zeros(top, dtype=np.int32)
        number[value] = 1
        number = np.cumsum(number, dtype=np.int32) - 1
        value, top = number[value], int(number[-1]) + 1
    return value.astype(np.uint16 if top < 1 << 16 else np.uint32)


def merged_intervals(data: np.ndarray, place: np.ndarray, windows: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts in merged order, interval number of each) to a depth of ``window`` symbols.

    ``place``: position of each byte in its segment; ``windows``: number of
    windows of its segment; ``cuts``: shard bounds.  Segments end in a pad.
    With ``rest`` symbols still to come only the suffixes that lie
    ``rest`` places after a window's start lead to an answer; the others are
    left out of the pass, in the transforms as in the interleave, which keeps
    the order of those that stay.
    """
    # Suffixes alike in a window's bytes are in one interval throughout, in whatever order.
    order = np.concatenate([a + suffix_order(data[a:b], window) for a, b in zip(cuts[:-1], cuts[1:])])
    used = np.bincount(data, minlength=256) > 0
    codes = (np.cumsum(used) - 1).astype(np.int16)[data]
    shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)).astype(np.uint8 if len(cuts) <= 256 else np.uint16)      # of the entries in the shards' orders
    short = np.int16 if int(place.max(initial=0)) < 1 << 14 else np.int32
    past, after = place[order].astype(short), (place - windows)[order].astype(short)

    def leads(rest: int) -> np.ndarray:
        return (past >= rest) & (after < rest)

    rest, transforms = window, {}                        # symbols before each entry, in the shards' orders
    now = leads(rest)
    z = shard[now]
    interval, new = np.zeros(len(z), dtype=np.int32), np.ones(len(z), dtype=np.int32)
    while rest:
        steps = rest % STEPS or STEPS
        if steps not in transforms:
            transforms[steps] = _before(codes, steps)[order]
        symbol = np.empty(len(z), dtype=transforms[steps].dtype)
        symbol[np.argsort(z, kind="stable")] = transforms[steps][now]
        dealt = np.argsort(symbol, kind="stable")
        s, i = symbol[dealt], interval[dealt]
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        z, interval = z[dealt], np.cumsum(new, dtype=np.int32)
        rest -= steps
        now = leads(rest)
    merged = np.empty(len(z), dtype=np.int64)
    merged[np.argsort(z, kind="stable")] = order[now]
    return merged, interval


def _merged_least(body: np.ndarray, size: np.ndarray, low: np.ndarray, window: int, shard_bytes: int) -> np.ndarray:
    """The smallest ``low`` of each window of some segments, by one merge."""
    windows = size - window + 1
    # each segment followed by its pad
    padded = np.cumsum(size + 1) - (size + 1)
    n = int((size + 1).sum())
    data = np.zeros(n, dtype=np.uint8)
    data[A.ranges(padded, size)] = body
    seg = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(n) - padded[seg]
    bounds = np.append(padded, n)
    shards = np.unique(np.searchsorted(bounds, np.arange(0, n, shard_bytes)))
    cuts = np.unique(np.append(bounds[shards], n))
    merged, interval = merged_intervals(data, place, windows[seg], cuts, window)
    start, end = A.runs_of(interval)
    smallest = np.minimum.reduceat(low[seg[merged]], start)
    least = np.full(n, LAST_ID)
    least[merged] = np.repeat(smallest, end - start)
    return least[A.ranges(padded, windows)]


def match_by_merge(window: int, shard_bytes: int = SHARD_BYTES, gram: int = GRAM, group_bytes: int = GROUP_BYTES):
    """Segments are merged in groups by their window key (equal windows have equal keys), so a merge works within a core's cache."""
    def match(body: np.ndarray, offsets: np.ndarray, low: np.ndarray):
        size = np.diff(offsets)
        windows = size - window + 1
        of = np.repeat(np.arange(len(size)), windows)
        key = np.concatenate([np.minimum.reduceat(A.gram_hash(A.byte_symbols(body[offsets[a]: offsets[b]]), gram)[A.ranges(offsets[a:b] - offsets[a], size[a:b] - gram + 1)],
                                                  np.cumsum(size[a:b] - gram + 1) - (size[a:b] - gram + 1)) for a, b in A.pieces(offsets)])
        order = np.argsort(key, kind="stable")
        start, end = A.runs_of(key[order])
        held = np.cumsum(size[order])[end - 1]
        _, last = np.unique(held // group_bytes, return_index=True)       # first key of each group
        least, at = np.empty(len(of), dtype=np.int64), np.cumsum(windows) - windows
        for a, b in zip(start[last], np.append(start[last[1:]], len(order))):
            one = order[a:b]
            least[A.ranges(at[one], windows[one])] = _merged_least(body[A.ranges(offsets[one], size[one])], size[one], low[one], window, shard_bytes)
        return of, least
    return match


def _finish(u: Units, offsets: np.ndarray, removed: np.ndarray) -> dict[str, pa.Array]:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start, end = A.runs_of(removed, text)
    gone = removed[start] if len(start) else np.zeros(0, bool)
    spans = np.bincount(text[start[gone]], minlength=len(offsets) - 1)
    n_removed = count_by_text(offsets, removed)
    s, e = start[gone], end[gone]
    at = np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)
    base = offsets[text[s]]
    lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["start", "end"]))
    return {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "spans": lists,
            "kept": binary_column(u.data[~removed], np.cumsum(np.diff(offsets) - n_removed))}


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                          text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove the UTF-8 bytes covered by a ``window``-byte string that also starts in a smaller doc_id.

    Returns doc_id, the ``keep`` columns, n_bytes, n_removed, spans (start and
    end of each maximal removed run) and kept (the remaining bytes, which need
    not be valid UTF-8), one row for each input row.  A null text is empty;
    texts shorter than the window keep all bytes.  Rows with equal doc_id are
    not earlier than each other; a null doc_id comes after all others.  An
    empty table gives an empty result.  Other columns are not read.
    """
    return repeated_windows(docs, "byte", window, gram, match_by_merge(window, gram=gram), _finish,
                            "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", id_col, text_col, keep)
