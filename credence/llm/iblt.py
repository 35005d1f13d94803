"""Document fingerprints by invertible Bloom lookup sketches (operator 3).

A document is a set of paragraph digests.  A paragraph ends at a line break,
and in long lines after a word whose hash says so, so an edit changes only the
paragraphs it touches.  A sketch is a small table of cells (count, xor of
digests, xor of check sums); each digest goes to three cells.  Subtracting two
sketches leaves the digests in which the documents differ; cells that hold one
digest are peeled until none is left.  If peeling gets stuck, both sketches
are made anew, four times as large.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import block_count, shuffle_width

U = np.uint64
CELLS, HASHES, GROWTH = 24, 3, 4
PARAGRAPH_WORDS = 16                     # mean words after which a long line is cut
BLOCK_BYTES = 64 << 20
_SALT = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, first index of each text) of the paragraphs; repeats of a paragraph get digests of their own."""
    w = A.Words(data, offsets)
    n = len(w.start)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, dtype=bool)
    last[:-1] = (text[1:] != text[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.symbol[:-1] % U(PARAGRAPH_WORDS) == 0)
    end = np.flatnonzero(last) + 1
    start = np.append(0, end[:-1])
    digest, owner = A.SpanHash(w.symbol)(start, end), text[start]
    order = np.lexsort((digest, owner))
    s, e = A.runs_of(digest[order], owner[order])
    nth = np.empty(len(digest), dtype=U)
    nth[order] = (np.arange(len(order)) - np.repeat(s, e - s)).astype(U)
    return A.mix(digest + nth * _SALT[0]), np.searchsorted(owner, np.arange(len(offsets)))


def cells_of(x: np.ndarray, row: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest in the table of its row, one line for each hash."""
    part = cells // HASHES
    return np.stack([row * cells + j * part + (A.mix(x ^ _SALT[j]) % U(part)).astype(np.int64) for j in range(HASHES)])


def check_of(x: np.ndarray) -> np.ndarray:
    return (A.mix(x * _SALT[2] + U(1)) >> U(32)).astype(np.uint32)


class Sketches:
    """One table of ``cells`` cells for each of ``rows`` sets."""

    def __init__(self, x: np.ndarray, row: np.ndarray, rows: int, cells: int):
        self.cells, self.rows = cells, rows
        at = cells_of(x, row, cells)
        self.count = np.bincount(at.ravel(), minlength=rows * cells).astype(np.int32)
        self.key, self.check = np.zeros(rows * cells, dtype=U), np.zeros(rows * cells, dtype=np.uint32)
        check = check_of(x)
        for line in at:
            np.bitwise_xor.at(self.key, line, x)
            np.bitwise_xor.at(self.check, line, check)

    def text(self) -> list[str]:
        """Each table as text: counts, keys, check sums."""
        c, k, s = (v.reshape(self.rows, self.cells) for v in (self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4")))
        return [base64.b64encode(a.tobytes() + b.tobytes() + d.tobytes()).decode("ascii") for a, b, d in zip(c, k, s)]

    def minus(self, other: "Sketches") -> "Sketches":
        out = object.__new__(Sketches)
        out.cells, out.rows = self.cells, self.rows
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, side) of all recovered digests, and which rows came out whole."""
        got = []
        looked = np.flatnonzero(np.abs(self.count) == 1)
        while len(looked):
            pure = looked[(np.abs(self.count[looked]) == 1) & (check_of(self.key[looked]) == self.check[looked])]
            if not len(pure):
                break
            row, x, side = pure // self.cells, self.key[pure], self.count[pure]
            order = np.lexsort((x, row))
            s, _ = A.runs_of(row[order], x[order])
            row, x, side = row[order[s]], x[order[s]], side[order[s]]
            got.append((row, x, side))
            at = cells_of(x, row, self.cells)
            for line in at:
                np.subtract.at(self.count, line, side)
                np.bitwise_xor.at(self.key, line, x)
                np.bitwise_xor.at(self.check, line, check_of(x))
            looked = np.unique(at)
        row, x, side = (np.concatenate(v) for v in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int32))
        whole = ~((self.count != 0) | (self.key != 0)).reshape(self.rows, self.cells).any(axis=1)
        return row, x, side, whole


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of the digests in only one set of each pair; side 1: the first, -1: the second.

    ``a`` and ``b`` are (digests, first index) of as many sets.
    """
    (xa, fa), (xb, fb) = a, b
    open_, found = np.arange(len(fa) - 1), []
    while len(open_):
        sides = []
        for x, f in ((xa, fa), (xb, fb)):
            n = np.diff(f)[open_]
            sides.append(Sketches(x[A.ranges(f[open_], n)], np.repeat(np.arange(len(open_)), n), len(open_), cells))
        row, x, side, whole = sides[0].minus(sides[1]).peel()
        done = whole[row]
        found.append((open_[row[done]], x[done], side[done]))
        open_, cells = open_[~whole], cells * GROWTH
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int32))


def likeness(a, b) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair, from sizes and recovered differences; two empty sets: 1."""
    size = (np.diff(a[1]) + np.diff(b[1])).astype(float)
    apart = np.bincount(differences(a, b)[0], minlength=len(size))
    return np.where(size > 0, (size - apart) / np.maximum(size + apart, 1), 1.0)


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _versions(ids: pa.Array, texts: list[str], after: list[str], cells: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The results of some texts, each followed by its text of ``after``."""
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for a, b in A.pieces(bounds):
        chars = [len(t) for t in texts[a:b]]
        edited = [(t[: c - c // 3] + x[: c // 3]).encode() for t, x, c in zip(texts[a:b], after[a:b], chars)]
        own, new, following = (paragraphs(*_spans(v)) for v in ([t.encode() for t in texts[a:b]], edited, [t.encode() for t in after[a:b]]))
        sketch = [Sketches(x, np.repeat(np.arange(b - a), np.diff(f)), b - a, cells).text() for x, f in (own, new)]
        yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(chars, pa.int64()), pa.array([sha256(e).hexdigest() for e in edited]),
                                          *map(pa.array, sketch), pa.array(likeness(own, new)), pa.array(likeness(own, following))], schema=schema)


def _inside(cells: int, schema: pa.Schema):
    """Results of all rows of a sorted partition but the last, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = pa.array([], pa.int64()), []              # the row carried over from the batch before
        for batch in batches:
            ids, texts = pa.concat_arrays([ids, batch.column("doc_id")]), [*texts, *batch.column("text").to_pylist()]
            if len(texts) > 1:
                yield from _versions(ids[:-1], texts[:-1], texts[1:], cells, schema)
            ids, texts = ids[-1:], texts[-1:]
    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first text and the last row of a sorted partition, with its number."""
    from pyspark import TaskContext
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column("text")[0].as_py() if first is None else first
            last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), last.column("doc_id"), last.column("text")],
                                         names=["part", "first", "doc_id", "text"])


def _last(cells: int, schema: pa.Schema):
    """Results of rows that come with the text that follows them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _versions(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("after").to_pylist(), cells, schema)
    return run


def fingerprint_versions(docs: DataFrame, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 3) code points
    replaced by the first as many (or all) of the next document's, in
    descending doc_id; after the last comes the first.  Rows that share a
    doc_id follow in the order of their texts' SHA-256; null ids come last.  A
    null text is empty; an empty text has an empty sketch, and two empty
    sketches are alike (1.0).  An empty table gives an empty result.  Other
    columns are not read.

    The rows are dealt by ranges of (doc_id, digest of the text), so null ids
    and rows of one id spread over tasks, and sorted within each.  A task has
    the next text of all its rows but the last; that one gets the first text
    of the following task, one row for each task.  All uses are one query and
    share the shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("digest").asc()]
    parts = docs.withColumn("digest", F.sha2("text", 256)).repartitionByRange(block_count(docs, BLOCK_BYTES), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    edges = parts.mapInArrow(_edges, "part int, first string, doc_id long, text string").repartition(shuffle_width(docs.sparkSession), "part")
    order = Window.orderBy("part")                              # one number for each task
    numbers = edges.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(order)))
    last = (edges.select("part", "doc_id", "text").join(numbers, "part")
            .join(edges.select(F.col("part").alias("next"), F.col("first").alias("after")), "next").select("doc_id", "text", "after"))
    return parts.mapInArrow(_inside(cells, schema), result).unionByName(last.mapInArrow(_last(cells, schema), result))
