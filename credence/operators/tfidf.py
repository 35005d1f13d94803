"""Deterministic TF-IDF in long form.

Shapes:
  terms    (doc_id, ..., terms ARRAY<STRING>)       one row per document
  tf       (doc_id, ..., term, tf BIGINT)            distinct (doc, term) pairs
  vocab    (term_id INT, term, df, n, idf)           <= max_features rows
  weights  (doc_id, ..., term_id, weight DOUBLE)     L2-normalised tf*idf
  moments  (term_id, mean, std, scale)               population moments

Partitioning: the per-document steps group on ``doc_id`` (plus the term), so
when the input is already hash-partitioned by ``doc_id`` (for example the
output of a sort-merge join with the labels) Catalyst plans them without a
new exchange.  Per-term steps shuffle on ``term``/``term_id`` after a
map-side partial aggregation, so a very frequent term costs one row per map
task, not one row per occurrence.  The fitted vocabulary and moments are
bounded by ``max_features`` and are the only things collected or broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.session import check_broadcast_size, materialize
from credence.functions.text import (NULL_TEXT, clean_words, ngrams_1_2, unicode_tokens,
                                     weighted_text)

# Vectoriser settings of the cluster detector and of the forest.
DETECTOR_MAX_FEATURES = 2000
DETECTOR_MIN_DF = 2
FOREST_MAX_FEATURES = 1000
FOREST_MIN_DF = 1
# End of fixed values.

_EPS = 2.220446049250313e-16  # float64 machine epsilon


def detector_terms(articles: DataFrame, keep: tuple[str, ...] = ("is_fake",),
                   title_col: str = "title", text_col: str = "text",
                   title_weight: int = 2, null_as: str = NULL_TEXT) -> DataFrame:
    """(doc_id, *keep, terms): cleaned unigrams + bigrams of ``title title text``."""
    doc = weighted_text(title_col, text_col, title_weight=title_weight, null_as=null_as)
    keep = tuple(k for k in keep if k in articles.columns)
    # Two projections: the cleaned words are computed once and the n-gram
    # expression refers to them as a column (Catalyst does not inline a
    # costly expression that is referenced several times).
    words = articles.select("doc_id", *keep, clean_words(doc).alias("_w"))
    return words.select("doc_id", *keep, ngrams_1_2(F.col("_w")).alias("terms"))


def token_terms(articles: DataFrame, text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, terms): plain Unicode word tokens (forest/classifier input)."""
    keep = tuple(k for k in keep if k in articles.columns)
    return articles.select("doc_id", *keep, unicode_tokens(text_col).alias("terms"))


def term_frequencies(terms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, term, tf): one row per distinct term of each document."""
    keep = tuple(k for k in keep if k in terms.columns)
    # explode_outer + a filter on its output: a plain explode makes the
    # optimizer infer ``size(terms) > 0`` and push it below the projection,
    # which would evaluate the whole tokenizer twice.
    return (terms.select("doc_id", *keep, F.explode_outer("terms").alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy("doc_id", *keep, "term")
            .agg(F.count(F.lit(1)).alias("tf")))


def document_frequencies(tf: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df, n): documents containing the term and its corpus count."""
    return (tf.groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("n"))
            .filter(F.col("df") >= min_df))


def smooth_idf(df_col, n_docs: int):
    """ln((1 + N) / (1 + df)) + 1 as a Column expression."""
    return F.log(F.lit(float(1 + n_docs)) / (F.lit(1.0) + df_col)) + F.lit(1.0)


@dataclass(frozen=True)
class Vocabulary:
    """Fitted vocabulary: ``terms[i]`` has id ``i`` (alphabetical order)."""

    terms: tuple[str, ...]
    df: tuple[int, ...]
    n: tuple[int, ...]
    n_docs: int

    @property
    def idf(self) -> tuple[float, ...]:
        return tuple(math.log((1 + self.n_docs) / (1 + d)) + 1.0 for d in self.df)

    def __len__(self) -> int:
        return len(self.terms)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, d, c, w) for i, (t, d, c, w)
                in enumerate(zip(self.terms, self.df, self.n, self.idf))]
        return spark.createDataFrame(
            rows, "term_id int, term string, df bigint, n bigint, idf double")


# Terms that may be left to order once the cut is narrowed this far.
CUT_ROWS = 4096
_OCTAVE = 8               # buckets for each doubling of the corpus count
_RANGES = 4096            # equal count ranges of one narrowing step
_CUT_BYTES = 2            # bytes of the term that one narrowing step among equal counts looks at


def _cut_bucket(buckets: list[tuple], need: int) -> tuple[object, int]:
    """Of (bucket, rows) in order, the bucket that holds place ``need`` and the places left to take from it."""
    for bucket, rows in buckets:
        if need <= rows:
            return bucket, need
        need -= rows
    raise AssertionError("the cut lies beyond all buckets")


def top_terms(tf: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """Top ``max_features`` terms by corpus count (ties: term ascending).

    Histograms find the cut before anything is ordered: one on a logarithmic
    scale of the counts, then of equal ranges inside the cut's bucket until a
    single count is left, then by the leading bytes of the terms with that
    count.  Each is one aggregation with a bounded number of buckets.  The
    terms before the cut are a filter; at most ``CUT_ROWS`` terms (or those
    that share every byte looked at) around it are ordered.
    """
    if not max_features or max_features <= 0:
        raise ValueError("max_features must be a positive bound: the vocabulary is broadcast")
    check_broadcast_size(max_features, "vocabulary")
    stats = materialize(document_frequencies(tf, min_df))

    def counted(rows: DataFrame, bucket) -> list[tuple]:
        return [(r["b"], r["rows"]) for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows")).collect()]

    octave = F.floor(F.log2(F.col("n").cast("double")) * F.lit(_OCTAVE)).cast("int")
    buckets = sorted(counted(stats, octave), reverse=True)
    if sum(rows for _, rows in buckets) <= max_features:
        return stats
    sizes = dict(buckets)
    at, need = _cut_bucket(buckets, max_features)
    sure, inside, left = stats.where(octave > at), stats.where(octave == at), sizes[at]
    while left > CUT_ROWS:
        low, high = inside.agg(F.min("n"), F.max("n")).first()
        if low == high:
            break
        width = -(-(high - low + 1) // _RANGES)
        part = F.floor((F.col("n") - F.lit(low)) / F.lit(width)).cast("long")
        buckets = sorted(counted(inside, part), reverse=True)
        at, need = _cut_bucket(buckets, need)
        left, sure, inside = dict(buckets)[at], sure.unionByName(inside.where(part > at)), inside.where(part == at)
    place = 1
    while left > CUT_ROWS and inside.where(F.octet_length("term") >= place).limit(1).count():
        lead = F.hex(F.substring(F.col("term").cast("binary"), place, _CUT_BYTES))
        buckets = sorted(counted(inside, lead))
        at, need = _cut_bucket(buckets, need)
        left, sure, inside = dict(buckets)[at], sure.unionByName(inside.where(lead < at)), inside.where(lead == at)
        place += _CUT_BYTES
    return sure.unionByName(inside.orderBy(F.desc("n"), F.asc("term")).limit(need))


def vocabulary_df(tf: DataFrame, n_docs: int, max_features: int, min_df: int) -> DataFrame:
    """Lazy form of the vocabulary: (term_id, term, df, n, idf)."""
    top = top_terms(tf, max_features, min_df)
    # At most max_features rows reach this window.
    w = Window.orderBy("term")
    return top.select((F.row_number().over(w) - 1).cast("int").alias("term_id"),
                      "term", "df", "n", smooth_idf(F.col("df"), n_docs).alias("idf"))


def fit_vocabulary(tf: DataFrame, n_docs: int, max_features: int, min_df: int) -> Vocabulary:
    """Collect the (bounded) top-K vocabulary and number it alphabetically."""
    rows = top_terms(tf, max_features, min_df).collect()
    rows.sort(key=lambda r: r["term"].encode("utf-8"))
    return Vocabulary(tuple(r["term"] for r in rows), tuple(int(r["df"]) for r in rows),
                      tuple(int(r["n"]) for r in rows), int(n_docs))


def tfidf_weights(tf: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, term_id, weight): tf * idf, L2-normalised per document.

    Out-of-vocabulary terms are dropped by an inner join with the broadcast
    vocabulary (at most ``max_features`` rows).  A document none of whose
    terms is in the vocabulary has no rows (its vector is zero).
    """
    keep = tuple(k for k in keep if k in tf.columns)
    v = F.broadcast(vocab.select("term", "term_id", "idf"))
    x = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(x * x).over(Window.partitionBy("doc_id")))
    return (tf.join(v, "term")
            .select("doc_id", *keep, "term_id", (x / norm).alias("weight")))


def feature_moments(weights: DataFrame, n_docs: int) -> DataFrame:
    """(term_id, mean, std, scale): population moments over all ``n_docs``.

    Documents without the term count as 0.  ``scale`` is the std, or 1 for a
    feature that is constant up to rounding (same rule as the usual
    standard scaler: var <= N*eps*var + (N*mean*eps)^2).  The variance is
    merged from the deviations of the documents that have the term and the
    weight of the others' zeros, so nothing cancels.
    """
    n = float(n_docs)
    held = weights.groupBy("term_id").agg(
        F.count("weight").cast("double").alias("m"), F.avg("weight").alias("held_mean"),
        F.var_pop("weight").alias("held_var"))
    share = F.col("m") / F.lit(n)
    zeros = (F.lit(n) - F.col("m")) / F.lit(n)
    moments = held.select("term_id", (F.col("held_mean") * share).alias("mean"),
                          (share * F.col("held_var") + F.col("held_mean") * F.col("held_mean") * share * zeros).alias("var"))
    var, mean = F.col("var"), F.col("mean")
    const = var <= F.lit(n * _EPS) * var + F.pow(F.lit(n * _EPS) * mean, 2)
    return moments.select("term_id", "mean", F.sqrt(var).alias("std"),
                          F.when(const, F.lit(1.0)).otherwise(F.sqrt(var)).alias("scale"))


@dataclass(frozen=True)
class Scaler:
    """Per-feature mean and scale, indexed by term_id."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    scale: tuple[float, ...]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m, s, c) for i, (m, s, c) in enumerate(zip(self.mean, self.std, self.scale))]
        return spark.createDataFrame(rows, "term_id int, mean double, std double, scale double")


def fit_scaler(weights: DataFrame, n_docs: int, n_features: int) -> Scaler:
    """Collect the K-row moments; a feature seen in no document gets scale 1."""
    mean, std, scale = [0.0] * n_features, [0.0] * n_features, [1.0] * n_features
    for r in feature_moments(weights, n_docs).collect():
        i = int(r["term_id"])
        mean[i], std[i], scale[i] = float(r["mean"]), float(r["std"]), float(r["scale"])
    return Scaler(tuple(mean), tuple(std), tuple(scale))


def scaled_weights(weights: DataFrame, scaler_df: DataFrame) -> DataFrame:
    """Adds ``v = weight / scale`` (uncentred: the mean is never subtracted).

    Euclidean distances are translation invariant, so scaling without
    centring keeps the vectors sparse; centroids live in the same space.
    """
    return (weights.join(F.broadcast(scaler_df.select("term_id", "scale")), "term_id", "left")
            .withColumn("v", F.col("weight") / F.col("scale")).drop("scale"))
