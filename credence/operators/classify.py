"""Supervised text classifiers (R1-R4, X1-X5, S8), in one place.

* ``fit_forest``: plain Unicode word tokens, top-1000 vocabulary, random forest
  (100 trees, seed 42, sqrt feature subsets), trees fitted by tasks and kept
  as a table.
* ``fit_epochs``: the sequence classifier's training loop on hashed features,
  any number of labels, evaluated after every epoch on the held-out split.
* ``classify_with``: a user's own batch model on fixed-length encodings.

Both classifiers classify rows where they are, load from where they were
saved, and have ``predict_one`` for a single text.
"""

from __future__ import annotations

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators import evaluate as V
from credence.operators.epochs import ADDED, SoftmaxClassifier, fit_epochs
from credence.operators.forest import Forest, fit_forest

__all__ = ["ADDED", "Forest", "SoftmaxClassifier", "classify_with", "fit_epochs", "fit_forest", "forest_trees"]

# Sequence-classifier settings.
SEQ_MAX_LENGTH = 512
# End of fixed values.


def forest_trees(forest: Forest, spark: SparkSession) -> DataFrame:
    """(tree, num_nodes, depth) of a fitted forest (one row per tree)."""
    return forest.nodes(spark).groupBy("tree").agg(F.count(F.lit(1)).alias("num_nodes"), F.max("depth").alias("depth"))


def classify_with(encoded: DataFrame, make_predict_fn, batch_size: int = 8, input_col: str = "input_ids",
                  max_length: int = SEQ_MAX_LENGTH) -> DataFrame:
    """Score fixed-length encodings with a user batch model.

    ``make_predict_fn()`` returns ``f(ndarray[batch, max_length]) ->
    ndarray[batch, num_labels]`` of logits; Spark feeds it Arrow batches.
    Adds logits, probabilities, prediction (first max) and class_confidence.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[max_length]])
    out = encoded.withColumn("logits", udf(F.col(input_col).cast("array<double>")))
    return V.with_softmax(out, "logits")
