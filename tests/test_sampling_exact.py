"""Exact selection with duplicate and null keys; log loss of confident errors."""

from collections import Counter

import pytest

from credence.operators.evaluate import log_loss
from credence.operators.sampling import sample_exact, split_exact


@pytest.fixture()
def rows(spark):
    data = [(i // 2, f"t{i}") for i in range(96)] + [(None, "a"), (None, "b"), (7, "same"), (7, "same")]
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3)


def test_sample_sizes(rows):
    for n in (1, 51, 99, 100, 200):
        assert sample_exact(rows, n).count() == min(n, 100)
    assert sample_exact(rows, None).count() == sample_exact(rows, 0).count() == 100


def test_split_covers_all_rows(rows):
    for share in (0.1, 0.33, 0.5):
        train, val = split_exact(rows, share)
        assert val.count() == -(-int(share * 1000) * 100 // 1000)
        assert Counter(map(tuple, train.union(val).collect())) == Counter(map(tuple, rows.collect()))


def test_selection_does_not_depend_on_partitions(rows):
    a, b = (Counter(map(tuple, sample_exact(r, 37).collect())) for r in (rows, rows.repartition(7)))
    assert a == b


def test_log_loss_counts_confident_errors(spark):
    df = spark.createDataFrame([([1000.0, 0.0], [1.0, 0.0], 1), ([0.0, 0.0], [0.5, 0.5], 1)], "logits array<double>, probabilities array<double>, truth int")
    assert log_loss(df).first()["log_loss"] == float("inf")
    assert log_loss(df, logits="logits").first()["log_loss"] == pytest.approx((1000 + 0.6931471805599453) / 2)
