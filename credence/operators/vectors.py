"""Vector forms of the TF-IDF features, row by row, with no shuffle.

* ``tfidf_stages``: ``CountVectorizerModel.from_vocabulary`` (a fixed,
  deterministic vocabulary) -> ``ElementwiseProduct(idf)`` -> ``Normalizer``
  [-> ``ElementwiseProduct(1/scale)``], for ML estimators.
* ``sparse_counts`` and what follows it: a document's vocabulary ids and counts
  as two short arrays.  The fitted numbers (idf, scale, centroids) are array
  literals indexed by the id, so norms and dot products touch only the terms
  that a document has.  Both run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.clusters import Centroids, squared_distance
from credence.operators.tfidf import Scaler, Vocabulary


def tfidf_stages(vocab: Vocabulary, input_col: str = "terms", output_col: str = "tfidf",
                 scaler: Scaler | None = None) -> list:
    cv = CountVectorizerModel.from_vocabulary(list(vocab.terms), inputCol=input_col,
                                              outputCol=f"{output_col}_tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense(list(vocab.idf)),
                             inputCol=f"{output_col}_tf", outputCol=f"{output_col}_raw")
    stages = [cv, idf]
    if scaler is None:
        stages.append(Normalizer(p=2.0, inputCol=f"{output_col}_raw", outputCol=output_col))
    else:
        stages.append(Normalizer(p=2.0, inputCol=f"{output_col}_raw", outputCol=f"{output_col}_l2"))
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense([1.0 / s for s in scaler.scale]),
                                         inputCol=f"{output_col}_l2", outputCol=output_col))
    return stages


def tfidf_vectors(vocab: Vocabulary, input_col: str = "terms", output_col: str = "features",
                  scaler: Scaler | None = None) -> PipelineModel:
    return PipelineModel(stages=tfidf_stages(vocab, input_col, output_col, scaler))


def drop_intermediate(df, output_col: str):
    """Without the columns that ``tfidf_stages`` makes on the way to ``output_col``."""
    return df.drop(*[f"{output_col}_{step}" for step in ("tf", "raw", "l2")])


# --- sparse rows

IDS, COUNTS = "_ids", "_counts"


def sparse_counts(df: DataFrame, vocab: Vocabulary, terms_col: str = "terms") -> DataFrame:
    """``df`` without ``terms_col``, with the ids of its vocabulary terms (``_ids``, ascending) and their counts (``_counts``).

    Terms outside the vocabulary are dropped by a hash-set test, the others are
    looked up in the transformer's hash map, both in the JVM; nothing is exploded.
    """
    if not len(vocab):
        return df.drop(terms_col).withColumn(IDS, F.array().cast("array<int>")).withColumn(COUNTS, F.array().cast("array<double>"))
    listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in vocab.terms)
    known = df.withColumn("_known", F.expr(f"filter(`{terms_col}`, t -> t IN ({listed}))")).drop(terms_col)
    counted = CountVectorizerModel.from_vocabulary(list(vocab.terms), inputCol="_known", outputCol="_vector").transform(known)
    vector = F.unwrap_udt(F.col("_vector"))
    return (counted.withColumn(IDS, vector["indices"]).withColumn(COUNTS, vector["values"]).drop("_known", "_vector"))


def number_array(values) -> Column:
    """An ARRAY<DOUBLE> constant: one string literal that the optimizer folds, instead of one literal a number."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values) or "0.0"), ",").cast("array<double>")


def row_sums(*numbers, squared: tuple[int, ...] = ()) -> Column:
    """ARRAY<DOUBLE>: for each list of numbers the sum of count * number[id] over a row's terms; of squared counts for those in ``squared``.

    All rows of an Arrow batch are summed at once, the terms of a row in order.
    """
    tables = [np.array(values, dtype=np.float64) for values in numbers]

    @F.arrow_udf("array<double>")
    def sums(ids: pa.Array, counts: pa.Array) -> pa.Array:
        size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, at = np.repeat(np.arange(len(ids)), size), ids.flatten().to_numpy(zero_copy_only=False)
        once = counts.flatten().to_numpy(zero_copy_only=False)
        twice = once * once
        out = np.empty((len(ids), len(tables)))
        for j, held in enumerate(tables):
            out[:, j] = np.bincount(row, (twice if j in squared else once) * held[at], len(ids)) if len(at) else 0.0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(tables)), pa.array(out.ravel()))
    return sums(IDS, COUNTS)


def norm(vocab: Vocabulary) -> Column:
    """Length of a row's tf-idf vector before normalising."""
    return F.sqrt(row_sums([w * w for w in vocab.idf], squared=(0,))[0])


def with_d2(sparse: DataFrame, vocab: Vocabulary, scaler: Scaler, centroids: Centroids, name: str = "_d2") -> DataFrame:
    """``sparse`` with ``name``: ARRAY<DOUBLE> of squared distances to each centroid.

    With x = count * idf and n = |x|, the scaled vector is x / (n * scale), so
    its squares and products are sums of counts times fixed numbers.
    """
    unit = [w / s for w, s in zip(vocab.idf, scaler.scale)]
    summed = sparse.withColumn("_sums", row_sums([w * w for w in vocab.idf], [u * u for u in unit],
                                                 *[[u * c for u, c in zip(unit, values)] for values in centroids.values], squared=(0, 1)))
    at = lambda i: F.col("_sums")[i]
    vv = F.when(at(0) > 0, at(1) / at(0)).otherwise(F.lit(0.0))
    d2 = [squared_distance(vv, F.when(at(0) > 0, at(2 + j) / F.sqrt(at(0))).otherwise(F.lit(0.0)), sq_norm)
          for j, sq_norm in enumerate(centroids.sq_norms)]
    return summed.withColumn(name, F.array(*d2)).drop("_sums")


def long_weights(sparse: DataFrame, vocab: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, term_id, weight) of sparse rows: the long form of the L2-normalised tf-idf."""
    idf = number_array(vocab.idf)
    rows = sparse.select("doc_id", *keep, norm(vocab).alias("_norm"), F.arrays_zip(IDS, COUNTS).alias("_terms"))
    return (rows.select("doc_id", *keep, "_norm", F.explode("_terms").alias("_t"))
            .select("doc_id", *keep, F.col("_t")[IDS].alias("term_id"),
                    (F.col("_t")[COUNTS] * F.get(idf, F.col("_t")[IDS]) / F.col("_norm")).alias("weight")))
