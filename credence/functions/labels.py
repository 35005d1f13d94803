"""Label encodings, score/verdict arithmetic and array helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class vocabulary of labelled files and verdict labels.
FAKE_LABEL = "FAKE"
REAL_LABEL = "REAL"
VERDICT_FAKE = "FAKE NEWS"
VERDICT_TRUE = "TRUE INFORMATION"
# Centre of the logistic distance penalty and the decision threshold.
PENALTY_CENTER = 2.0
DECISION_THRESHOLD = 0.5
# End of fixed values.


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_is_fake(c: Column | str, null_is_true: bool = False) -> Column:
    """Numeric label -> boolean by truthiness (non-zero is fake).

    ``null_is_true`` reproduces pandas, where a missing value (NaN) is truthy.
    """
    b = _col(c) != 0
    return F.coalesce(b, F.lit(True)) if null_is_true else b


def encode_label(c: Column | str, positive: str = FAKE_LABEL) -> Column:
    """String class label -> 1 for ``positive``, 0 otherwise, NULL stays NULL."""
    x = _col(c)
    return F.when(x.isNull(), F.lit(None).cast("int")) \
        .when(x == positive, F.lit(1)).otherwise(F.lit(0))


def label_of(is_fake: Column | str) -> Column:
    """Boolean -> 'FAKE' / 'REAL'."""
    return F.when(_col(is_fake), F.lit(FAKE_LABEL)).otherwise(F.lit(REAL_LABEL))


# --- cluster score (K5 - K7) -------------------------------------------------

def logistic_penalty(z: Column | str, center: float = PENALTY_CENTER) -> Column:
    """1 / (1 + exp(center - z)); +inf -> 1, -inf -> 0, NaN -> NaN."""
    zc = _col(z)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(center) - zc))


def fake_score(cluster_fake_ratio: Column | str, penalty: Column | str) -> Column:
    return (_col(cluster_fake_ratio) + _col(penalty)) / F.lit(2.0)


def decide(score: Column | str, threshold: float = DECISION_THRESHOLD) -> Column:
    """``score > threshold``; a NaN (NaN > x is TRUE in Spark) or NULL score is not fake."""
    s = _col(score)
    return F.when(F.isnan(s), F.lit(False)).otherwise(F.coalesce(s > F.lit(threshold), F.lit(False)))


def margin_confidence(score: Column | str, threshold: float = DECISION_THRESHOLD) -> Column:
    return F.abs(_col(score) - F.lit(threshold)) * F.lit(2.0)


def zscore(distance: Column | str, mean: Column | str, std: Column | str) -> Column:
    """(d - mean) / std with the numpy meaning of std = 0: +-inf or NaN."""
    d, m, s = _col(distance), _col(mean), _col(std)
    return (F.when(s != 0, (d - m) / s)
            .when(d > m, F.lit(float("inf")))
            .when(d < m, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


# --- arrays: softmax / argmax / confidence (X3, X4, R3) ----------------------

def softmax(logits: Column | str) -> Column:
    """Numerically stable softmax of a numeric array."""
    arr = _col(logits)
    mx = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - mx))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(arr: Column | str) -> Column:
    """0-based index of the first maximum."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def predicted_confidence(prediction: Column | str, probabilities: Column | str) -> Column:
    """Probability of the predicted class."""
    return F.element_at(_col(probabilities), _col(prediction).cast("int") + 1)


def verdict(prediction: Column | str) -> Column:
    return F.when(_col(prediction) == 1, F.lit(VERDICT_FAKE)).otherwise(F.lit(VERDICT_TRUE))


def percent_text(confidence: Column | str) -> Column:
    """``'%.1f%%'`` of 100 * confidence."""
    return F.format_string("%.1f%%", _col(confidence) * F.lit(100.0))
