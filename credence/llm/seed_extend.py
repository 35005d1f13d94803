"""Substring de-duplication by seed and extend (operator 2).

Seeds are winnowed anchors: the gram with the smallest hash among the grams of
a window.  Documents meet on equal anchors; from a seed the match is extended
word by word to the right and to the left.  Instead of extending each pair,
all seeds of an anchor are extended together: after d words the seeds that
still agree form one class, and a class of one seed stops.  A window that
reaches i words left of its seed matches exactly the seeds that share its left
class at i and its right class at window - i, so the smallest doc_id of that
class is known without making pairs.  The union of the matching windows is the
union of the maximal repeats of at least ``window`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm import arrays as A
from credence.llm.repeats import Units, binary_column, count_by_text, gram_keys, key_of, repeated_windows

WINDOW, GRAM = 50, 25


def _refine(active: np.ndarray, classes: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split classes by the next symbol; seeds alone in their class stop."""
    if not len(active):
        return active, classes
    order = np.lexsort((symbol, classes))
    start, end = A.runs_of(classes[order], symbol[order])
    size = end - start
    new = np.repeat(np.arange(len(start)), size)
    more = np.repeat(size > 1, size)
    return active[order][more], new[more]


def _extended(seeds: np.ndarray, group: np.ndarray, steps: int, symbol_at, inside) -> list[np.ndarray]:
    """classes[d][seed]: class after d more words on one side; -1 where the seed stopped."""
    active, classes, out = np.arange(len(seeds)), group, []
    for d in range(steps + 1):
        if d:
            room = inside(active, d)
            active, classes = active[room], classes[room]
            active, classes = _refine(active, classes, symbol_at(active, d))
        level = np.full(len(seeds), -1, dtype=np.int64)
        level[active] = classes
        out.append(level)
    return out


def match_by_extension(window: int, gram: int):
    def match(body: np.ndarray, offsets: np.ndarray, low: np.ndarray):
        u = Units("word", body, offsets)
        first, symbols = u.first, u.symbol
        length = np.diff(first)
        windows = length - window + 1
        hashes = gram_keys(symbols, gram)
        key = key_of(A.sliding_min(hashes, window - gram + 1)[first[:-1]])
        of = np.repeat(np.arange(len(key)), windows)
        base = np.cumsum(windows) - windows                 # first window of each segment
        least = low[of].copy()
        grams = key_of(hashes)
        at = A.ranges(first[:-1], length - gram + 1)
        seg = np.repeat(np.arange(len(key)), length - gram + 1)
        is_seed = grams[at] == key[seg]
        seed, seg = at[is_seed], seg[is_seed]
        _, group = np.unique(key[seg], return_inverse=True)
        begin, end = first[seg], first[seg + 1]
        reach = window - gram
        right = _extended(seed, group, reach, lambda s, d: symbols[seed[s] + gram + d - 1], lambda s, d: seed[s] + gram + d <= end[s])
        left = _extended(seed, group, reach, lambda s, d: symbols[seed[s] - d], lambda s, d: seed[s] - d >= begin[s])
        for i in range(reach + 1):
            l, r = left[i], right[reach - i]
            s = np.flatnonzero((l >= 0) & (r >= 0))
            if not len(s):
                continue
            order = s[np.lexsort((r[s], l[s]))]
            rs, re_ = A.runs_of(l[order], r[order])
            smallest = np.repeat(np.minimum.reduceat(low[seg[order]], rs), re_ - rs)
            np.minimum.at(least, base[seg[order]] + seed[order] - i - begin[order], smallest)
        return of, least
    return match


def _finish(u: Units, offsets: np.ndarray, removed: np.ndarray) -> dict[str, pa.Array]:
    w = u.words
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))[~removed]
    start, end = w.start[~removed], w.end[~removed]
    last = np.ones(len(text), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    size = end - start + ~last                              # a word and the separator after it
    out = np.append(u.data, np.uint8(0x20))[A.ranges(start, size)]
    out[(np.cumsum(size) - 1)[~last]] = 0x20
    per_text = np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64)
    return {"n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(count_by_text(w.first, removed)),
            "kept_text": binary_column(out, np.cumsum(per_text)).cast(pa.string())}


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                             text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove the words covered by a ``window``-word sequence that also starts in a smaller doc_id.

    Returns doc_id, the ``keep`` columns, n_words, n_removed and kept_text (the
    kept words joined by one space), one row for each input row.  A null or
    empty text, or one shorter than the window, keeps all its words (none).
    Rows with equal doc_id are not earlier than each other; a null doc_id comes
    after all others.  An empty table gives an empty result.  Columns other
    than the id, the text and ``keep`` are not read, so their names cannot
    clash; a ``keep`` column must not be named like a result column.
    """
    return repeated_windows(docs, "word", window, gram, match_by_extension(window, gram), _finish,
                            "n_words long, n_removed long, kept_text string", id_col, text_col, keep)
