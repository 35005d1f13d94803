"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams (operator 12).

Features are 48-bit hashes of single words, word pairs and pairs with one or
two words between them, each counted once in a text; letters A-Z are folded and
ASCII punctuation separates words.  Every coordinate has its own learning rate
(from the sum of its squared gradients), and the L1 term leaves most weights at
exactly zero, so the fitted model is a short table of (feature, weight) that
every task can hold.

Training is in rounds.  The training rows are dealt to learners by a hash of
their id; in a round every learner runs FTRL over its rows, starting from the
shared state, and the changes of a coordinate are averaged over the learners
that touched it.  A learner takes in a feature only from ``MIN_ROWS`` rows on
(feature inclusion), which keeps the state small.  Learners fit on at most
``train_rows`` rows, chosen by a hash of the id; all rows are scored.

Defined results: a null or empty text has the score of the intercept alone; a
null doc_id is not held out and is never learnt from; rows that share a doc_id
are scored each, and the least of their texts is learnt from (of several
labels, the largest); a null label is none; without any label all scores are
0.5.  Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import materialize, text_bytes

U = np.uint64
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 0.0
TRAIN_ROWS, ROUNDS, MIN_ROWS = 16_000, 6, 4
LEARNER_ROWS, LEARNER_BYTES = 1000, 4 << 20
UNIT = 2.0 ** 32                   # changes travel as whole numbers of 1 / UNIT, which add up to the same in any order
BITS = 48
PIECE_TEXTS = 1 << (64 - BITS)
INTERCEPT = 0                      # its key among the features; hashes start at 1
THRESHOLD = 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
_SKIPS = (1, 2, 3)                 # distance of the two words of a pair
_SALT = np.random.default_rng(12).integers(1, 1 << 62, 2 + len(_SKIPS), dtype=np.uint64) * U(2) + U(1)


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, pair and skip-pair of at most ``PIECE_TEXTS`` texts, repeats included."""
    words = A.Words(_FOLD[data], offsets)
    symbol, text = words.symbol, np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(words.first))
    texts, hashes = [text], [A.mix(symbol * _SALT[0])]
    for skip, salt in zip(_SKIPS, _SALT[2:], strict=True):
        same = text[:-skip] == text[skip:]
        texts.append(text[:-skip][same])
        hashes.append(A.mix((symbol[:-skip] * _SALT[1] + A.mix(symbol[skip:] * salt))[same]))
    return np.concatenate(texts), np.maximum(np.concatenate(hashes) >> U(64 - BITS), U(1))


def once(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, feature) pairs, sorted."""
    packed = np.unique((text.astype(U) << U(BITS)) | feature)
    return (packed >> U(BITS)).astype(np.int64), packed & U((1 << BITS) - 1)


def text_pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in A.pieces(offsets):
        for c in range(a, b, PIECE_TEXTS):
            yield c, min(b, c + PIECE_TEXTS)


def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float = L1) -> np.ndarray:
    """FTRL-proximal weights of coordinates with state (z, n)."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over ``rows`` (indices of the coordinates that are 1); changes z and n in place.

    Coordinate 0 is the intercept, which has no L1 term.
    """
    l1 = np.full(len(z), L1)
    l1[0] = 0.0
    for at, label in zip(rows, labels, strict=True):
        w = weights(z[at], n[at], l1[at])
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30.0, 30.0))) - label
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown


def _learner(state_keys: np.ndarray, state_z: np.ndarray, state_n: np.ndarray):
    """One learner's pass from a shared state; yields what it changed."""
    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        data, offsets = A.text_arrays(table["text"])
        texts, features = [], []
        for a, b in text_pieces(offsets):
            t, f = once(*feature_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]))
            texts.append((t + a).astype(np.int32))
            features.append(f)
        text, feature = np.concatenate(texts), np.concatenate(features)
        del texts, features
        found, counts = np.unique(feature, return_counts=True)
        keys = np.append(U(INTERCEPT), np.union1d(found[counts >= MIN_ROWS], np.intersect1d(found, state_keys)))
        keys = np.unique(keys)
        z, n = np.zeros(len(keys)), np.zeros(len(keys))
        if len(state_keys):
            at = np.minimum(np.searchsorted(state_keys, keys), len(state_keys) - 1)
            known = state_keys[at] == keys
            z[known], n[known] = state_z[at[known]], state_n[at[known]]
        place = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
        taken = keys[place] == feature
        text, place = text[taken], place[taken]
        ends = np.searchsorted(text, np.arange(table.num_rows + 1))
        rows = [np.append(0, place[ends[i]: ends[i + 1]]) for i in range(table.num_rows)]
        before = z.copy(), n.copy()
        ftrl_pass(rows, table["label"].to_numpy().astype(float), z, n)
        return pa.table({"feature": pa.array(keys.astype(np.int64)), "dz": pa.array(np.round((z - before[0]) * UNIT).astype(np.int64)),
                         "dn": pa.array(np.round((n - before[1]) * UNIT).astype(np.int64))})
    return learn


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label, place): at most ``train_rows`` labelled rows outside the held-out third, by hash of the id."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("label")).withColumn("place", F.xxhash64("doc_id")))
    own = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = known.join(own, "doc_id", "left_semi").orderBy("place", "doc_id").limit(train_rows)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "place", "label").agg(F.min("text").alias("text")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> pd.DataFrame:
    """The non-zero weights (feature, weight), intercept included.

    The state that goes through the driver after a round has the features that
    some learner took in, at most those of ``train_rows`` texts.
    """
    rows = materialize(training_rows(docs, labels, train_rows))
    learners = max(1, -(-rows.count() // LEARNER_ROWS), -(-text_bytes(rows) // LEARNER_BYTES))
    dealt = rows.withColumn("learner", F.pmod("place", F.lit(learners)).cast("int"))
    state = pd.DataFrame({"feature": np.zeros(0, np.int64), "z": np.zeros(0), "n": np.zeros(0)})
    for _ in range(rounds):
        learn = _learner(state["feature"].to_numpy().astype(U), state["z"].to_numpy(), state["n"].to_numpy())
        mean = (dealt.groupBy("learner").applyInArrow(learn, "feature long, dz long, dn long").groupBy("feature")
                .agg(*[(F.sum(x) / F.count(F.lit(1)) / UNIT).alias(x) for x in ("dz", "dn")]))
        state = (state.merge(mean.toPandas(), on="feature", how="outer").fillna(0.0)
                 .assign(z=lambda s: s.z + s.dz, n=lambda s: s.n + s.dn)[["feature", "z", "n"]].sort_values("feature", ignore_index=True))
    l1 = np.where(state["feature"] == INTERCEPT, 0.0, L1)
    model = state.assign(weight=weights(state["z"].to_numpy(), state["n"].to_numpy(), l1))[["feature", "weight"]]
    return model[model["weight"] != 0].reset_index(drop=True)


def scores_of(column: pa.Array, keys: np.ndarray, weight: np.ndarray, intercept: float) -> np.ndarray:
    """The score of each text of an Arrow column; keys are sorted."""
    data, offsets = A.text_arrays(column)
    total = np.full(len(column), intercept)
    for a, b in text_pieces(offsets):
        text, feature = feature_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
        if not len(keys) or not len(text):
            continue
        known = keys[np.minimum(np.searchsorted(keys, feature), len(keys) - 1)] == feature
        text, feature = once(text[known], feature[known])
        total[a:b] += np.bincount(text, weight[np.searchsorted(keys, feature)], b - a)
    return 1.0 / (1.0 + np.exp(-np.clip(total, -500.0, 500.0)))


def score_toxicity(docs: DataFrame, model: pd.DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    own = model["feature"] == INTERCEPT
    intercept = float(model.loc[own, "weight"].sum())
    keys, weight = model.loc[~own, "feature"].to_numpy().astype(U), model.loc[~own, "weight"].to_numpy()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores_of(batch.column("text"), keys, weight, intercept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
            .mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int"))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled rows outside the held-out third, score every document."""
    return score_toxicity(docs, fit_toxicity(docs, labels, train_rows))
