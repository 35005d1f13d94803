"""Near-duplicate documents by SetSketch registers (operator 8).

A document's set of word shingles becomes ``REGISTERS`` registers.  A register
is the smallest of exponentially distributed hash values of the shingles, on a
logarithmic scale with base ``BASE``, truncated to whole numbers: registers of
a union are the larger ones of the parts, and two sets agree in a register
with a probability of at least their Jaccard similarity.  Bands of ``ROWS``
registers propose candidates, the joint likelihood of larger, smaller and
equal registers (given both set sizes) estimates the similarity, and the full
sets confirm a link.

Documents with equal sets are one class; only one document of a class goes on.
In a band bucket each class is first paired with the smallest doc_id, never
with all others.  After these links are joined to components, only buckets
that still hold several components are compared further, across components,
in tiles of bounded size that return only links which join components; so
every candidate pair is either confirmed or refuted, or already lies within
one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import materialize, restrict
from credence.llm.components import components

U = np.uint64
REGISTERS, ROWS = 120, 5
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
MARGIN = 6.0          # standard deviations of the estimate that a candidate may lie below the threshold
TILE = 1000           # classes of a bucket compared at once
PIECE_TEXTS = 4096    # texts in a piece: their number and 52 bits of hash share a word
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(85)
_FACTOR = _rng.integers(1, 1 << 62, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_SHIFT = _rng.integers(0, 1 << 62, REGISTERS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index of each text): the distinct shingles of at most ``PIECE_TEXTS`` texts, sorted."""
    w = A.Words(_LOWER[data], offsets)
    n = np.diff(w.first)
    grams = np.maximum(n - k + 1, 0)
    text = np.repeat(np.arange(len(n), dtype=U), grams)
    h = A.gram_hash(w.symbol, k)[A.ranges(w.first[:-1], grams)] if len(text) else np.zeros(0, U)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        text = np.append(text, short.astype(U))
        h = np.append(h, A.SpanHash(w.symbol)(w.first[short], w.first[short + 1]))
    packed = np.sort((text << U(52)) | (h >> U(12)))
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    first = np.searchsorted(packed, np.arange(len(n) + 1, dtype=U) << U(52)) if len(n) < PIECE_TEXTS else np.append(np.searchsorted(packed, np.arange(len(n), dtype=U) << U(52)), len(packed))
    return A.mix((packed & U((1 << 52) - 1)) + U(1)), first


def set_pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in A.pieces(offsets):
        for c in range(a, b, PIECE_TEXTS):
            yield c, min(b, c + PIECE_TEXTS)


def registers_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The register row of each non-empty set."""
    least = np.empty((len(first), REGISTERS), dtype=np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((h * _FACTOR[i] + _SHIFT[i]) >> U(32), first)
    smallest = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    bands = REGISTERS // rows
    r = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), r.shape[:2]).copy()
    for j in range(rows):
        key = A.mix(key * U(0x9E3779B97F4A7C15) + r[:, :, j])
    return key.view(np.int64)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood for register rows a and b of sets of n_a and n_b."""
    above, below = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = a.shape[-1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        x, y = p(u - v * j), p(v - u * j)
        return above * np.log(np.maximum(x, 1e-12)) + below * np.log(np.maximum(y, 1e-12)) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(25):                                   # concave: golden section
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = value(c) > value(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _floor(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _sketch(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_arrays(batch.column("text"))
            for a, b in set_pieces(offsets):
                h, first = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                one, two = np.zeros((2, b - a), dtype=U)
                bands = np.zeros((b - a, REGISTERS // rows), dtype=np.int64)
                rows_ = np.zeros((b - a, REGISTERS), dtype=np.uint16)
                if len(full):
                    at = first[full]
                    one[full] = np.add.reduceat(h, at)
                    two[full] = np.add.reduceat(A.mix(h ^ U(0x5851F42D4C957F2D)), at)
                    rows_[full] = registers_of(h, at)
                    bands[full] = band_keys(rows_[full], rows)
                width = bands.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * width, width, dtype=np.int32)), pa.array(bands.ravel())),
                    pa.array([r.tobytes() for r in rows_], pa.binary())], names=["doc_id", "n_shingles", "digest_1", "digest_2", "bands", "registers"])
    return run


def _register_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _estimate(threshold: float):
    least = _floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                j = likely_jaccard(*(_register_matrix(batch.column(c)) for c in ("registers_a", "registers_b")),
                                   *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")))
                yield batch.select(["a", "b"]).filter(pa.array(j >= least))
    return run


def _confirm(k: int, percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            (da, oa), (db, ob) = (A.text_arrays(batch.column(c)) for c in ("text_a", "text_b"))
            for a, b in set_pieces(oa + ob):
                (ha, fa), (hb, fb) = (shingle_sets(d[o[a]: o[b]], o[a: b + 1] - o[a], k) for d, o in ((da, oa), (db, ob)))
                pair = np.concatenate([np.repeat(np.arange(b - a), np.diff(fa)), np.repeat(np.arange(b - a), np.diff(fb))])
                h = np.concatenate([ha, hb])
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=b - a)
                union = np.diff(fa) + np.diff(fb) - both
                keep[a:b] = (union > 0) & (100 * both >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _candidates(band: int, s: int, t: int, table: pa.Table, least: float, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile, of different components, that agree in no earlier band and are estimated near the threshold."""
    side = table.column("part").to_numpy()
    ids, comp, n = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
    reg = _register_matrix(table.column("registers").combine_chunks())
    bands = band_keys(reg, rows)
    earlier = bands[:, : int(np.flatnonzero(bands[0] == band)[0])]
    left, right = np.flatnonzero(side == s), np.flatnonzero(side == t)
    got = []
    for at in range(0, len(left), 32):
        i = left[at: at + 32]
        ok = (comp[i][:, None] != comp[right]) & ((ids[right] > ids[i][:, None]) | (s != t))
        ok &= 100 * np.minimum(n[i][:, None], n[right]) >= percent * np.maximum(n[i][:, None], n[right])
        x, y = np.nonzero(ok)
        for c in range(0, len(x), 20_000):
            a, b = i[x[c: c + 20_000]], right[y[c: c + 20_000]]
            near = (reg[a] == reg[b]).sum(axis=1) >= REGISTERS * (least - 0.05)
            a, b = a[near], b[near]
            first = ~(earlier[a] == earlier[b]).any(axis=1)
            a, b = a[first], b[first]
            if len(a):
                near = likely_jaccard(reg[a], reg[b], n[a].astype(float), n[b].astype(float)) >= least
                got.append((a[near], b[near]))
    a, b = (np.concatenate(v) for v in zip(*got)) if got else (np.zeros((2, 0), dtype=np.int64))
    return a, b


def _involved(threshold: float, rows: int, percent: int):
    """The classes of a tile that are in some candidate pair."""
    least = _floor(threshold)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, s, t = (k.as_py() for k in key)
        a, b = _candidates(band, s, t, table, least, rows, percent)
        return table.take(pa.array(np.unique(np.append(a, b)))).select(["band", "s", "t", "part", "rep", "component", "n_shingles", "registers"])
    return run


def _tile_links(threshold: float, rows: int, percent: int, k: int):
    """Confirmed links of a tile; pairs that earlier links have joined need no comparison."""
    least = _floor(threshold)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, s, t = (x.as_py() for x in key)
        ids, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        data, offsets = A.text_arrays(table.column("text"))
        sets = []
        for a, b in set_pieces(offsets):
            h, first = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], k)
            sets += [np.sort(h[x:y]) for x, y in zip(first[:-1], first[1:])]
        group = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        left, right = _candidates(band, s, t, table, least, rows, percent)
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        links = []
        for x, y in zip(*A.runs_of(left)):
            i = left[x]
            others = [j for j in right[x:y].tolist() if root(comp[j]) != root(comp[i])]
            if not others:
                continue
            size = np.array([len(sets[j]) for j in others])
            joined = np.concatenate([sets[j] for j in others])
            found = sets[i][np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)] == joined
            both = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
            for j in np.array(others)[100 * both >= percent * (len(sets[i]) + size - both)].tolist():
                if root(comp[j]) != root(comp[i]):
                    group[root(comp[j])] = root(comp[i])
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 3, percent: int = 85, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the set
    holds the distinct ``shingle_words``-word shingles, or the whole sequence
    of a shorter text.  Two documents are linked where 100 * intersection >=
    percent * union; ``component_id`` is the smallest doc_id reachable over
    links, and ``kept`` marks it.  A null or blank text has an empty set and no
    link.  Rows that share a doc_id are taken as one document; a null doc_id
    is linked with nothing, gets a null component and is kept.  An empty table
    gives an empty result.  Columns other than the id and the text are not read.
    """
    threshold = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(docs.mapInArrow(_sketch(shingle_words, rows), "doc_id long, n_shingles long, digest_1 long, digest_2 long, bands array<long>, registers binary"))
    digest = ["digest_1", "digest_2", "n_shingles"]
    usable = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(usable.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("registers").alias("registers")))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    known = classes.select("rep", "n_shingles", "registers")
    stars = banded.join(leaders, "band").where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.select("doc_id", "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        used = restrict(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
        whole = (pairs.join(used.toDF("a", "text_a"), "a").join(used.toDF("b", "text_b"), "b"))
        return materialize(whole.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle_words, percent), "a long, b long").distinct())

    estimated = (stars.join(known.toDF("a", "n_a", "registers_a"), "a").join(known.toDF("b", "n_b", "registers_b"), "b")
                 .select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(_estimate(threshold), "a long, b long"))
    links = confirmed(materialize(estimated))
    label = components(links)

    # buckets that still hold several components
    labelled = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = labelled.select("rep", "component", "n_shingles", F.explode("bands").alias("band"))
    mixed = (members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
             .where("low < high").select("band", F.ceil(F.col("size") / TILE).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")
    tiles = (members.join(mixed, "band").withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("band", F.least("part", "other").alias("s"), F.greatest("part", "other").alias("t"), "part", "rep", "component", "n_shingles")
             .join(known.select("rep", "registers"), "rep"))
    tile = ["band", "s", "t"]
    shape = "band long, s int, t int, part int, rep long, component long, n_shingles long, registers binary"
    involved = materialize(tiles.groupBy(*tile).applyInArrow(_involved(threshold, rows, percent), shape))
    if not involved.isEmpty():
        used = restrict(texts, involved.select(F.col("rep").alias("doc_id")))
        whole = involved.join(used.toDF("rep", "text"), "rep").select(*involved.columns, "text")
        more = materialize(whole.groupBy(*tile).applyInArrow(_tile_links(threshold, rows, percent, shingle_words), "a long, b long"))
        if not more.isEmpty():
            label = components(links.union(more))

    of_class = classes.select(*digest, "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component"))
    return (sketches.select("doc_id", *digest).join(of_class, digest, "left")
            .select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
