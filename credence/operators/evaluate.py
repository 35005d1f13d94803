"""Prediction evaluation: alignment, accuracy, confusion counts, binary
precision/recall/F1, cross-entropy loss and best epoch (J5, A10-A14).

Every metric is a single grouped aggregation over a prediction table; the
optional ``group`` column (e.g. ``epoch``) evaluates many runs in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.labels import argmax, predicted_confidence, softmax
from credence.operators.ranking import global_positions


def align(pred: DataFrame, truth: DataFrame, on: str = "doc_id") -> DataFrame:
    """Prediction <-> truth by key (an equi-join; positions play no role)."""
    return pred.join(truth, on)


def _ratio(num, den):
    """num / den, 0 when den = 0 (the usual zero-division convention)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, pred: str = "prediction", truth: str = "truth",
             group: str | None = None) -> DataFrame:
    """n, correct, accuracy; a NULL prediction or truth counts as wrong."""
    g = [group] if group else []
    right = F.coalesce(F.col(pred) == F.col(truth), F.lit(False))
    return df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).cast("bigint").alias("correct"),
        F.avg(right.cast("double")).alias("accuracy"))


def confusion(df: DataFrame, pred: str = "prediction", truth: str = "truth",
              group: str | None = None) -> DataFrame:
    g = [group] if group else []
    return df.groupBy(*g, F.col(truth).alias("truth"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, pred: str = "prediction", truth: str = "truth",
                   group: str | None = None, positive: int = 1) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, precision, recall, f1 of the positive class."""
    g = [group] if group else []
    p, t = F.col(pred) == positive, F.col(truth) == positive
    counts = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p & t).cast("bigint").alias("tp"),
        F.count_if(p & ~t).cast("bigint").alias("fp"),
        F.count_if(~p & t).cast("bigint").alias("fn"),
        F.count_if(~p & ~t).cast("bigint").alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    return (counts.withColumn("accuracy", _ratio(tp + tn, n))
            .withColumn("precision", prec)
            .withColumn("recall", rec)
            .withColumn("f1", _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)))


def with_softmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds probabilities, argmax prediction and its probability."""
    return (df.withColumn("probabilities", softmax(logits))
            .withColumn("prediction", argmax(logits))
            .withColumn("class_confidence", predicted_confidence("prediction", "probabilities")))


def log_loss(df: DataFrame, truth: str = "truth", probabilities: str = "probabilities",
             group: str | None = None, batch_size: int | None = None,
             order_col: str | None = None, logits: str | None = None) -> DataFrame:
    """Mean cross-entropy -ln p[truth].

    A probability of 0 for the true class costs infinity; it is never skipped.
    From ``logits`` (which then take the place of the probabilities) the loss
    stays finite: max + ln(sum(exp(x - max))) - x[truth].

    With ``batch_size`` the rows (in ``order_col`` order) are cut into
    consecutive batches; the loss is the mean of the per-batch means, so a
    short last batch weighs as much as a full one.
    """
    g = [group] if group else []
    true_at = F.col(truth).cast("int") + 1
    if logits:
        top = F.array_max(logits)
        spread = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda acc, v: acc + v)
        nll = top + F.log(spread) - F.element_at(F.col(logits), true_at)
    else:
        p_true = F.element_at(F.col(probabilities), true_at)
        nll = F.when(p_true > 0, -F.log(p_true)).when(p_true.isNotNull(), F.lit(float("inf")))
    x = df.withColumn("_nll", nll)
    if not batch_size:
        return x.groupBy(*g).agg(F.avg("_nll").alias("log_loss"))
    if not order_col:
        raise ValueError("batched loss needs an order column")
    pos = global_positions(x.select(*g, order_col, "_nll"), [order_col], group, "_pos")
    batches = (pos.withColumn("_batch", F.floor(F.col("_pos") / F.lit(batch_size)))
               .groupBy(*g, "_batch").agg(F.avg("_nll").alias("_m")))
    return batches.groupBy(*g).agg(F.avg("_m").alias("log_loss"),
                                   F.count(F.lit(1)).alias("batches"))


def best_epoch(metrics: DataFrame, epoch: str = "epoch", score: str = "accuracy") -> DataFrame:
    """The epoch with the highest score; the earliest one wins ties."""
    key = F.struct(F.col(score), -F.col(epoch))
    return metrics.agg(F.max_by(epoch, key).alias("best_epoch"),
                       F.max(score).alias(f"best_{score}"))
