"""Text classification trained by epochs.

The sequence classifier's training loop on hashed features: tokens fall into
``buckets`` by a hash (no vocabulary, so no term is dropped and nothing has to
be fitted before the weights), a text is its L2-normalised tf-idf over the
buckets, and a softmax layer is trained by AdamW with gradient clipping and a
linearly decaying rate.  The rows of an epoch are dealt into ``steps`` blocks
by a hash of the id; a step is one job that sums the block's gradient over all
tasks, and the next step goes on from the moved weights.

Weights, moments and idf are arrays of buckets x labels, a bound set by the
parameters; rows stay on the executors.  The blocks are written once, by
block, so a step reads its own rows only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions.text import optional_title_text, stringify, unicode_tokens
from credence.operators import evaluate as V
from credence.operators import sampling as M
from credence.session import check_broadcast_size, scratch_folder

# The training loop's settings.
EPOCHS, NUM_LABELS, EVAL_BATCH = 3, 2, 8
BETA1, BETA2, EPS, WEIGHT_DECAY, CLIP = 0.9, 0.999, 1e-8, 0.01, 1.0
# End of fixed values.
BUCKETS = 1 << 18
STEPS = 4
RATE = 0.1

ADDED = ("prediction", "probabilities", "class_confidence", "p_fake", "verdict", "confidence_text")


def document_text(df: DataFrame, title_col: str | None, text_col: str) -> Column:
    """The text to classify; a missing text reads as ``'nan'``, as elsewhere in the library."""
    text = stringify(text_col)
    return optional_title_text(title_col, text) if title_col and title_col in df.columns else text


def token_buckets(text: Column, buckets: int, max_tokens: int | None = None) -> Column:
    """ARRAY<INT>: the bucket of every token, from the leading 32 bits of its MD5."""
    tokens = unicode_tokens(text)
    if max_tokens:
        tokens = F.slice(tokens, 1, max_tokens)
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % buckets).cast("int"))


def bucket_idf(ids: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Smooth idf of every bucket over the ``n`` rows of ``ids`` (ids); a bucket that none has counts as in 0 rows."""
    rows = ids.select(F.explode(F.array_distinct("ids")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df")).toPandas()
    df = np.zeros(buckets)
    df[rows["b"].to_numpy()] = rows["df"].to_numpy()
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def sparse_rows(ids: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): the L2-normalised tf-idf of every row of a list column."""
    lists = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    row = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(ends))
    key, count = np.unique(row * len(idf) + flat, return_counts=True)
    row, bucket = key // len(idf), key % len(idf)
    x = count * idf[bucket]
    norm = np.sqrt(np.bincount(row, x * x, len(lists)))
    return row, bucket, x / norm[row]


def logits_of(ids: pa.Array, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    row, bucket, x = sparse_rows(ids, idf)
    return bias + np.stack([np.bincount(row, x * weights[bucket, j], len(ids)) for j in range(len(bias))], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(block: DataFrame, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(gradient of the weights, of the bias, mean loss, rows) of the mean cross-entropy over ``block`` (label, ids).

    Every task adds up its rows first and sends each touched bucket once; the
    sums by bucket are a distributed aggregation.
    """
    classes = len(bias)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, extra = np.zeros((len(idf), classes)), np.zeros(classes + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").to_numpy()
            row, bucket, x = sparse_rows(batch.column("ids"), idf)
            z = bias + np.stack([np.bincount(row, x * weights[bucket, j], len(label)) for j in range(classes)], axis=1)
            p = softmax(z)
            top = z.max(axis=1)
            extra[classes] += (top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(label)), label]).sum()
            extra[classes + 1] += len(label)
            p[np.arange(len(label)), label] -= 1.0
            extra[:classes] += p.sum(axis=0)
            for j in range(classes):
                total[:, j] += np.bincount(bucket, x * p[row, j], len(idf))
        touched = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(np.append(touched, [-1, -2, -3]))]
        tails = [[extra[j], extra[classes] if j == 0 else 0.0, extra[classes + 1] if j == 0 else 0.0] for j in range(classes)]
        columns += [pa.array(np.append(total[touched, j], tails[j])) for j in range(classes)]
        yield pa.RecordBatch.from_arrays(columns, names=["b", *[f"g{j}" for j in range(classes)]])

    names = [f"g{j}" for j in range(classes)]
    sums = (block.select("label", "ids").mapInArrow(part, "b long, " + ", ".join(f"{g} double" for g in names))
            .groupBy("b").agg(*[F.sum(g).alias(g) for g in names]).toPandas().set_index("b"))
    n = sums.loc[-3, "g0"] if -3 in sums.index else 0.0
    if not n:
        return np.zeros_like(weights), np.zeros(classes), 0.0, 0
    own = sums[sums.index >= 0]
    g = np.zeros_like(weights)
    g[own.index.to_numpy()] = own[names].to_numpy()
    return g / n, sums.loc[-1, names].to_numpy() / n, sums.loc[-2, "g0"] / n, int(n)


@dataclass
class AdamW:
    """Decoupled weight decay, bias-corrected moments, gradient clipped to norm ``CLIP``; the rate falls linearly to 0 over ``total`` steps."""

    total: int
    rate: float
    done: int = 0
    state: list = field(default_factory=list)

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.state:
            self.state = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
        rate = self.rate * (self.total - self.done) / self.total
        self.done += 1
        scale = min(1.0, CLIP / (np.sqrt(sum((g * g).sum() for g in grads)) + 1e-6))
        for value, g, (m, v) in zip(values, grads, self.state, strict=True):
            g = g * scale
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            value *= 1 - rate * WEIGHT_DECAY
            value -= rate * (m / (1 - BETA1 ** self.done)) / (np.sqrt(v / (1 - BETA2 ** self.done)) + EPS)


@dataclass
class SoftmaxClassifier:
    """Fitted weights, and what is needed to score with them and to load them again."""

    weights: np.ndarray               # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    text_col: str = "text"
    title_col: str | None = None
    max_tokens: int | None = None
    model_name: str = "hashed-softmax"

    @property
    def num_labels(self) -> int:
        return len(self.bias)

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds prediction (first maximum), probabilities, class_confidence, p_fake (of label 1), verdict, confidence_text.

        Caller columns of other names stay as they are, those of these names
        are replaced; rows stay where they are.
        """
        idf, weights, bias = self.idf, self.weights, self.bias

        @F.pandas_udf("array<double>")
        def score(ids: pd.Series) -> pd.Series:
            return pd.Series(list(logits_of(pa.array(ids, pa.list_(pa.int64())), idf, weights, bias)))

        # The caller's row travels in one struct, so its names cannot meet the internal ones.
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                         token_buckets(document_text(df, self.title_col, self.text_col), len(idf), self.max_tokens).alias("_ids"))
        out = (V.with_softmax(rows.withColumn("_logits", score("_ids")), "_logits")
               .withColumn("p_fake", F.col("probabilities")[1])
               .withColumn("verdict", L.verdict("prediction"))
               .withColumn("confidence_text", L.percent_text("class_confidence")))
        return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in ADDED], *ADDED)

    def predict_one(self, spark: SparkSession, text: str, title: str | None = None) -> dict:
        """Classify one text: is_fake, label, confidence, probabilities, verdict, confidence_text."""
        schema = f"`{self.title_col or 'title'}` string, `{self.text_col}` string"
        r = self.classify(spark.createDataFrame([(title or "", text)], schema)).collect()[0]
        return {"is_fake": r["prediction"] == 1, "label": r["prediction"], "confidence": r["class_confidence"], "probabilities": list(r["probabilities"]),
                "verdict": r["verdict"], "confidence_text": r["confidence_text"]}

    def save(self, path: str, spark: SparkSession) -> None:
        """One row a bucket (idf and weights) and one row of metadata, as parquet tables."""
        lists = pa.FixedSizeListArray.from_arrays(self.weights.ravel(), self.num_labels).cast(pa.list_(pa.float64()))
        table = pa.table({"bucket": np.arange(len(self.idf), dtype=np.int32), "idf": self.idf, "weights": lists})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/weights")
        meta = {"model_name": self.model_name, "num_labels": self.num_labels, "bias": self.bias.tolist(), "buckets": len(self.idf),
                "text_col": self.text_col, "title_col": self.title_col, "max_tokens": self.max_tokens}
        spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxClassifier:
        meta = json.loads(spark.read.parquet(f"{path}/metadata").collect()[0]["metadata"])
        check_broadcast_size(meta["buckets"] * meta["num_labels"], "classifier weights")
        rows = spark.read.parquet(f"{path}/weights").toPandas().sort_values("bucket")
        return cls(np.stack(rows["weights"].to_numpy()), np.array(meta["bias"]), rows["idf"].to_numpy(), meta["text_col"], meta["title_col"],
                   meta["max_tokens"], meta["model_name"])


def _epoch_metrics(val: DataFrame, idf: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]], num_labels: int) -> pd.DataFrame:
    """Metrics of every epoch's weights on ``val`` (doc_id, label, ids), from one pass over its rows."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, (weights, bias) in enumerate(kept):
                z = logits_of(batch.column("ids"), idf, weights, bias)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(z), e + 1, np.int32)), batch.column("label"),
                                                  pa.array(list(z), pa.list_(pa.float64()))], names=["doc_id", "epoch", "truth", "logits"])
    kind = dict(val.dtypes)["doc_id"]
    scored = V.with_softmax(val.mapInArrow(score, f"doc_id {kind}, epoch int, truth int, logits array<double>")).persist()
    try:
        metrics = V.binary_metrics(scored, group="epoch").toPandas()
        loss = V.log_loss(scored, group="epoch", batch_size=EVAL_BATCH, order_col="doc_id", logits="logits").toPandas()
        right = scored.groupBy("epoch").agg(F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("accuracy")).toPandas()
    finally:
        scored.unpersist()
    return metrics.drop(columns="accuracy").merge(loss, on="epoch").merge(right, on="epoch").sort_values("epoch", ignore_index=True)


def fit_epochs(train: DataFrame, val: DataFrame | None = None, label_col: str = "label_id", num_labels: int = NUM_LABELS, title_col: str | None = None,
               text_col: str = "text", epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, buckets: int = BUCKETS,
               max_tokens: int | None = None, seed: int = M.DEFAULT_SEED, keep: str = "best") -> tuple[SoftmaxClassifier, DataFrame]:
    """Train with a validation set (given, or the seeded 10 % split); (classifier, history).

    ``train`` and ``val``: doc_id, ``label_col`` (0 .. ``num_labels`` - 1; a row
    with another or no label is left out) and the text.  The history has one row an epoch:
    epoch, n, accuracy, precision, recall, f1 (of label 1 against the others),
    log_loss (mean over batches of ``EVAL_BATCH`` rows), train_loss (mean over
    steps) and whether it is the best epoch (highest accuracy, the first of
    equals).  The classifier has the weights of the best epoch, or with
    ``keep='last'`` those of the last.
    """
    check_broadcast_size(buckets * num_labels, "classifier weights")
    spark = train.sparkSession
    if val is None:
        train, val = M.split_exact(train)

    def encoded(df: DataFrame) -> DataFrame:
        label = F.col(label_col).cast("int")
        return (df.where(label.between(0, num_labels - 1))
                .select("doc_id", label.alias("label"), token_buckets(document_text(df, title_col, text_col), buckets, max_tokens).alias("ids")))

    folder = scratch_folder(spark, "epochs")
    block = F.conv(F.substring(M.hash_key(f"{seed}:block"), 1, 8), 16, 10).cast("long") % steps
    encoded(train).withColumn("block", block.cast("int")).write.partitionBy("block").parquet(f"{folder}/train")
    encoded(val).write.parquet(f"{folder}/val")
    rows = spark.read.schema(f"doc_id {dict(train.dtypes)['doc_id']}, label int, ids array<int>, block int").parquet(f"{folder}/train")
    if (n_train := rows.count()) == 0 or spark.read.parquet(f"{folder}/val").isEmpty():
        raise ValueError("no labelled rows to train on, or none to validate on")
    idf = bucket_idf(rows, n_train, buckets)

    weights, bias = np.zeros((buckets, num_labels)), np.zeros(num_labels)
    optimiser, kept, losses = AdamW(epochs * steps, rate), [], []
    for _ in range(epochs):
        seen = []
        for b in range(steps):
            g, gb, loss, n = gradient(rows.where(F.col("block") == b), idf, weights, bias)
            if n:
                seen.append(loss)
            optimiser.step([weights, bias], [g, gb])
        losses.append(float(np.mean(seen)) if seen else 0.0)
        kept.append((weights.copy(), bias.copy()))
    history = _epoch_metrics(spark.read.parquet(f"{folder}/val"), idf, kept, num_labels).assign(train_loss=losses)
    best = int(history["accuracy"].to_numpy().argmax())
    weights, bias = kept[best if keep == "best" else -1]
    columns = ["epoch", "n", "accuracy", "precision", "recall", "f1", "log_loss", "train_loss"]
    shown = spark.createDataFrame([(*r, i == best) for i, r in enumerate(history[columns].itertuples(index=False, name=None))],
                                  "epoch int, n bigint, accuracy double, precision double, recall double, f1 double, log_loss double, train_loss double, best boolean")
    return SoftmaxClassifier(weights, bias, idf, text_col, title_col, max_tokens), shown
