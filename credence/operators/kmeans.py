"""k-means as DataFrame rounds that can be replayed (K1).

Rows are sparse (``vectors.sparse_counts``).  Seeding is k-means++ with its
chances taken from a seeded hash of the id: the first centroid is the article
with the least hash; for each further one an article with hash share u in
(0, 1) and squared distance d2 to the nearest chosen one waits -ln(u) / d2,
and the least wait wins, which draws it with probability d2 / sum(d2).  A
Lloyd round is one job over the scaled vectors, kept as packed blocks of rows:
every task finds the nearest centroid of its rows and adds up each cluster's
members, and one aggregation by term gives the new means.  Nothing but the
k x K means, the k sizes and one seed row a time reaches the driver; documents
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators import vectors as VF
from credence.operators.clusters import _D2_NOISE, Centroids
from credence.operators.sampling import hash_key
from credence.operators.tfidf import Scaler, Vocabulary
from credence.session import reuse

# Rows of one packed block.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Fit:
    """Centroids, rounds run, whether they had settled, and the squared shift of the last round."""

    centroids: Centroids
    rounds: int
    settled: bool
    shift: float


def _vector(row, vocab: Vocabulary, scaler: Scaler) -> tuple[float, ...]:
    """The scaled vector of one sparse row, dense (K numbers)."""
    x = {i: c * vocab.idf[i] for i, c in zip(row[VF.IDS], row[VF.COUNTS])}
    length = sum(v * v for v in x.values()) ** 0.5
    out = [0.0] * len(vocab)
    for i, v in x.items():
        out[i] = v / length / scaler.scale[i]
    return tuple(out)


def share(seed: int, step: int) -> Column:
    """A number in (0, 1) from the hash of the id: (h + 0.5) / 2^48 of the leading 12 hex digits."""
    digits = F.substring(hash_key(f"{seed}:{step}"), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def seeds(sparse: DataFrame, vocab: Vocabulary, scaler: Scaler, k: int, seed: int) -> Centroids:
    """k starting centroids drawn by the hash of the ids.

    With fewer than k different vectors the remaining centroids repeat the
    first; ties go to the lowest cluster, so those stay without members.
    """
    first = sparse.select(VF.IDS, VF.COUNTS, hash_key(seed).alias("_order")).orderBy("_order").limit(1).collect()
    values = [_vector(first[0], vocab, scaler)]
    while len(values) < k:
        rows = sparse.select(VF.IDS, VF.COUNTS, share(seed, len(values)).alias("_share"))
        waits = (VF.with_d2(rows, vocab, scaler, Centroids(tuple(values))).withColumn("_far", F.array_min("_d2")).where("_far > 0")
                 .select(VF.IDS, VF.COUNTS, (-F.log("_share") / F.col("_far")).alias("_wait")))
        drawn = waits.orderBy("_wait").limit(1).collect()
        values.append(_vector(drawn[0], vocab, scaler) if drawn else values[0])
    return Centroids(tuple(values))


def nearest(sparse: DataFrame, vocab: Vocabulary, scaler: Scaler, centroids: Centroids) -> DataFrame:
    """``sparse`` with ``cluster`` (lowest id on ties) and ``distance``."""
    least = F.array_min("_d2")
    return (VF.with_d2(sparse, vocab, scaler, centroids)
            .withColumn("cluster", (F.array_position("_d2", least) - 1).cast("int"))
            .withColumn("distance", F.sqrt(least)).drop("_d2"))


def means(assigned: DataFrame, vocab: Vocabulary, scaler: Scaler, before: Centroids) -> Centroids:
    """Mean vector of each cluster's members, for rows that have their ``cluster``; a cluster without members keeps its centroid."""
    # One row a cluster and term, and one a cluster for its size (term_id -1): at most k * (K + 1) rows, from one reading.
    idf, scale = VF.number_array(vocab.idf), VF.number_array(scaler.scale)
    size = F.struct(F.lit(-1).alias(VF.IDS), F.lit(1.0).alias(VF.COUNTS))
    rows = assigned.select("cluster", VF.norm(vocab).alias("_norm"), F.explode(F.concat(F.arrays_zip(VF.IDS, VF.COUNTS), F.array(size))).alias("_t"))
    term, count = F.col("_t")[VF.IDS], F.col("_t")[VF.COUNTS]
    v = F.when(term < 0, count).otherwise(count * F.get(idf, term) / F.col("_norm") / F.get(scale, term))
    totals = rows.select("cluster", term.alias("term_id"), v.alias("v")).groupBy("cluster", "term_id").agg(F.sum("v").alias("v"))
    sums = {(r["cluster"], r["term_id"]): r["v"] for r in totals.collect()}
    values = []
    for j, old in enumerate(before.values):
        n = sums.get((j, -1))
        values.append(tuple(sums.get((j, i), 0.0) / n for i in range(len(vocab))) if n else old)
    return Centroids(tuple(values))


def packed(sparse: DataFrame, vocab: Vocabulary, scaler: Scaler) -> DataFrame:
    """The scaled vectors of ``sparse``, ``BLOCK_ROWS`` of a partition's rows in one: as bytes, the rows' numbers of terms, the term ids and their values."""
    idf, scale = np.array(vocab.idf), np.array(scaler.scale)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                size = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
                row, ids = np.repeat(np.arange(len(size)), size), part.column(0).flatten().to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False) * idf[ids]
                v = x / np.sqrt(np.bincount(row, x * x, len(size)))[row] / scale[ids]
                held = [pa.array([a.astype(kind).tobytes()], pa.binary()) for a, kind in ((size, np.int32), (ids, np.int32), (v, np.float64))]
                yield pa.RecordBatch.from_arrays(held, names=["sizes", "ids", "vs"])
    return sparse.select(VF.IDS, VF.COUNTS).mapInArrow(pack, "sizes binary, ids binary, vs binary")


def moved(blocks: DataFrame, before: Centroids) -> Centroids:
    """The means of one Lloyd round: every row of ``blocks`` (``packed``) goes to its nearest centroid (lowest id on ties); a cluster without members keeps its centroid.

    Every task adds up its rows first and sends each touched term once; the
    sums by term are a distributed aggregation (term -1: the sizes).
    """
    k, old, norms = before.k, np.array(before.values), np.array(before.sq_norms)
    n_terms = old.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members = np.zeros(n_terms * k), np.zeros(k)
        for batch in batches:
            for block in zip(*batch.columns):
                size, ids, v = (np.frombuffer(b.as_py(), kind) for b, kind in zip(block, (np.int32, np.int32, np.float64)))
                row = np.repeat(np.arange(len(size)), size)
                vv = np.bincount(row, v * v, len(size))[:, None]
                raw = vv - 2.0 * np.stack([np.bincount(row, v * c[ids], len(size)) for c in old], axis=1) + norms
                near = np.where(raw <= _D2_NOISE * (vv + norms), 0.0, raw).argmin(axis=1)
                total += np.bincount(ids * k + near[row], v, n_terms * k)
                members += np.bincount(near, minlength=k)
        sums = total.reshape(n_terms, k)
        touched = np.flatnonzero(sums.any(axis=1))
        rows = np.vstack([sums[touched], members])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(touched, -1)), *[pa.array(rows[:, j].copy()) for j in range(k)]], names=["term_id", *names])

    names = [f"s{j}" for j in range(k)]
    sums = (blocks.mapInArrow(part, "term_id long, " + ", ".join(f"{s} double" for s in names))
            .groupBy("term_id").agg(*[F.sum(s).alias(s) for s in names]).toPandas().set_index("term_id"))
    n, own = sums.loc[-1, names].to_numpy(), sums[sums.index >= 0]
    new = np.zeros_like(old)
    new[:, own.index.to_numpy()] = own[names].to_numpy().T
    return Centroids(tuple(tuple((new[j] / n[j] if n[j] else old[j]).tolist()) for j in range(k)))


def fit_kmeans(sparse: DataFrame, vocab: Vocabulary, scaler: Scaler, k: int, seed: int, max_iter: int, tol: float) -> Fit:
    """Lloyd rounds from the seeds until the centroids' summed squared shift is at most ``tol``, or for ``max_iter`` rounds.

    ``sparse`` (doc_id, _ids, _counts) is read once for each seed: keep it.
    The rounds read its packed vectors, which are kept here.
    """
    centroids, shift = seeds(sparse, vocab, scaler, k, seed), float("inf")
    blocks = reuse(packed(sparse, vocab, scaler))
    try:
        for done in range(1, max_iter + 1):
            after = moved(blocks, centroids)
            shift = sum((a - b) ** 2 for old, new in zip(centroids.values, after.values) for a, b in zip(old, new))
            centroids = after
            if shift <= tol:
                return Fit(centroids, done, True, shift)
    finally:
        blocks.unpersist()
    return Fit(centroids, max_iter, False, shift)
