"""Random forest whose trees are fitted by tasks and kept as a table.

Features are the L2-normalised tf-idf of the top word tokens, as sparse rows
that are written once.  Trees are fitted on at most ``train_rows`` labelled
rows (by the seeded hash of the id): that matrix is bounded by the parameters,
its size is checked, and every task fits its share of the trees on it.  The
nodes of all trees are a parquet table; the driver holds them only to score,
after their number was checked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions.text import unicode_tokens
from credence.operators import sampling as M
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.operators.epochs import ADDED, document_text
from credence.session import check_broadcast_size, scratch_folder

# Forest settings.
TREES, SEED = 100, 42
# End of fixed values.
TRAIN_ROWS = 20_000                 # rows that a forest is fitted on at most
MATRIX_CELLS = 40_000_000           # rows x features of the training matrix: 160 MB as float32
NODES = "tree int, node int, depth int, feature int, threshold double, left int, right int, n bigint, p_fake double"


def dense_rows(ids: pa.Array, counts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The L2-normalised tf-idf of sparse rows as a float32 matrix."""
    ids, counts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, counts))
    row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
    at = ids.flatten().to_numpy(zero_copy_only=False)
    x = counts.flatten().to_numpy(zero_copy_only=False) * idf[at]
    norm = np.sqrt(np.bincount(row, x * x, len(ids)))
    out = np.zeros((len(ids), len(idf)), np.float32)
    out[row, at] = x / norm[row]
    return out


def best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, float] | None:
    """(column, threshold) of the largest drop of the weighted Gini impurity; None if every column is constant."""
    order = np.argsort(x, axis=0, kind="stable")
    value = np.take_along_axis(x, order, axis=0)
    n, ones = np.cumsum(w[order], axis=0), np.cumsum((w * y)[order], axis=0)
    left, left1 = n[:-1], ones[:-1]
    right, right1 = n[-1] - left, ones[-1] - left1
    purity = (left1 ** 2 + (left - left1) ** 2) / left + (right1 ** 2 + (right - right1) ** 2) / right
    purity[value[1:] <= value[:-1]] = -1.0
    at = int(purity.argmax())
    i, column = divmod(at, x.shape[1])
    if purity[i, column] < 0:
        return None
    low, high = value[i, column], value[i + 1, column]
    middle = np.float32((np.float64(low) + np.float64(high)) / 2)
    return column, float(middle if low <= middle < high else low)


def fit_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, max_depth: int | None) -> list[tuple]:
    """(node, depth, feature, threshold, left, right, n, p_fake) of one tree on a bootstrap of the rows; a leaf has feature -1.

    A node looks at sqrt(features) random columns, and at further ones while
    all of them are constant in its rows.
    """
    n, features = x.shape
    weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
    subset = max(1, int(np.sqrt(features)))
    nodes: list[list] = []
    todo = [(np.flatnonzero(weight), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me, w, own = len(nodes), weight[rows], y[rows]
        if parent >= 0:
            nodes[parent][4 + side] = me
        total, ones = w.sum(), (w * own).sum()
        nodes.append([me, depth, -1, 0.0, -1, -1, int(total), ones / total])
        if ones in (0.0, total) or (max_depth is not None and depth >= max_depth):
            continue
        split, columns = None, rng.permutation(features)
        for a in range(0, features, subset):
            split = best_split(x[np.ix_(rows, columns[a: a + subset])], own, w)
            if split is not None:
                break
        if split is None:
            continue
        feature, threshold = int(columns[a + split[0]]), split[1]
        nodes[me][2], nodes[me][3] = feature, threshold
        goes_left = x[rows, feature] <= threshold
        todo += [(rows[~goes_left], depth + 1, me, 1), (rows[goes_left], depth + 1, me, 0)]
    return [tuple(v) for v in nodes]


class Walker:
    """The nodes of all trees as arrays, walked by all rows at once."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.root = np.flatnonzero(nodes["node"].to_numpy() == 0)
        first = np.repeat(self.root, np.diff(np.append(self.root, len(nodes))))
        self.feature, self.threshold, self.p = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy().astype(np.float32), nodes["p_fake"].to_numpy()
        self.left, self.right = nodes["left"].to_numpy() + first, nodes["right"].to_numpy() + first

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the share of label 1 in the leaf of each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.root:
            at, going = np.full(len(x), root), rows
            while len(going):
                going = going[self.feature[at[going]] >= 0]
                node = at[going]
                at[going] = np.where(x[going, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.p[at]
        return total / len(self.root)


@dataclass
class Forest:
    vocab: X.Vocabulary
    path: str                         # folder of the node table
    title_col: str | None = "title"
    text_col: str = "text"
    model_name: str = "forest"

    def nodes(self, spark: SparkSession) -> DataFrame:
        """tree, node, depth, feature (-1: leaf), threshold, left, right, n, p_fake."""
        return spark.read.parquet(f"{self.path}/nodes")

    def sparse(self, df: DataFrame) -> DataFrame:
        """``df``'s rows in ``_row`` with the ids and counts of their vocabulary tokens."""
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                         unicode_tokens(document_text(df, self.title_col, self.text_col)).alias("_terms"))
        return VF.sparse_counts(rows, self.vocab, "_terms")

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds prediction, probabilities, class_confidence, p_fake, verdict, confidence_text; rows stay where they are."""
        table = self.nodes(df.sparkSession)
        check_broadcast_size(table.count(), "forest")
        walk, idf = Walker(table.toPandas()), np.array(self.vocab.idf)

        @F.pandas_udf("double")
        def score(ids: pd.Series, counts: pd.Series) -> pd.Series:
            parts = []
            for a in range(0, len(ids), 1000):
                own = [pa.array(v.iloc[a: a + 1000], t) for v, t in ((ids, pa.list_(pa.int32())), (counts, pa.list_(pa.float64())))]
                parts.append(walk(dense_rows(*own, idf)))
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        out = (self.sparse(df).withColumn("p_fake", score(VF.IDS, VF.COUNTS))
               .withColumn("probabilities", F.array(F.lit(1.0) - F.col("p_fake"), F.col("p_fake")))
               .withColumn("prediction", (F.col("p_fake") > 0.5).cast("int"))
               .withColumn("class_confidence", L.predicted_confidence("prediction", "probabilities"))
               .withColumn("verdict", L.verdict("prediction"))
               .withColumn("confidence_text", L.percent_text("class_confidence")))
        return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in ADDED], *ADDED)

    def predict_one(self, spark: SparkSession, text: str, title: str | None = None) -> dict:
        """Classify one text: is_fake, confidence, probabilities, verdict, confidence_text."""
        one = spark.createDataFrame([(title or "", text)], f"`{self.title_col or 'title'}` string, `{self.text_col}` string")
        r = self.classify(one).collect()[0]
        return {"is_fake": bool(r["prediction"]), "confidence": r["class_confidence"], "probabilities": list(r["probabilities"]),
                "verdict": r["verdict"], "confidence_text": r["confidence_text"]}

    def save(self, path: str, spark: SparkSession) -> None:
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        self.vocab.to_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")
        meta = {"title_col": self.title_col, "text_col": self.text_col, "model_name": self.model_name, "n_docs": self.vocab.n_docs, "num_labels": 2}
        spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        meta = json.loads(spark.read.parquet(f"{path}/metadata").collect()[0]["metadata"])
        rows = sorted(spark.read.parquet(f"{path}/vocab").collect(), key=lambda r: r["term_id"])
        vocab = X.Vocabulary(tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), tuple(r["n"] for r in rows), int(meta["n_docs"]))
        return cls(vocab, path, meta["title_col"], meta["text_col"], meta["model_name"])


def fit_forest(train: DataFrame, label_col: str = "label_id", title_col: str | None = "title", text_col: str = "text", trees: int = TREES, seed: int = SEED,
               max_features: int = X.FOREST_MAX_FEATURES, max_depth: int | None = None, train_rows: int = TRAIN_ROWS) -> Forest:
    """Random forest on ``train`` (doc_id, label 0 or 1, text): vocabulary and idf from all rows, trees from at most ``train_rows``."""
    spark = train.sparkSession
    rows = train.where(F.col(label_col).isin(0, 1))
    terms = rows.select("doc_id", F.col(label_col).cast("int").alias("label"), unicode_tokens(document_text(train, title_col, text_col)).alias("terms"))
    vocab = X.fit_vocabulary(X.term_frequencies(terms), rows.count(), max_features, X.FOREST_MIN_DF)
    folder = scratch_folder(spark, "forest")
    VF.sparse_counts(terms, vocab).write.parquet(f"{folder}/features")
    sample = M.sample_exact(spark.read.parquet(f"{folder}/features"), train_rows)
    if (n := min(train_rows, rows.count())) * len(vocab) > MATRIX_CELLS:
        raise ValueError(f"a training matrix of {n} x {len(vocab)} cells is above {MATRIX_CELLS}: lower train_rows or max_features")
    held = sample.orderBy(M.hash_key(), VF.IDS).toArrow()
    idf, label = np.array(vocab.idf), held["label"].to_numpy().astype(float)
    matrix = spark.sparkContext.broadcast((held[VF.IDS].combine_chunks(), held[VF.COUNTS].combine_chunks(), label))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, y = matrix.value
        x = dense_rows(ids, counts, idf)
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                columns = list(zip(*fit_tree(x, y, np.random.default_rng([seed, tree]), max_depth)))
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(columns[0]), pa.int32()),
                                                  *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))]],
                                                 names=[c.split()[0] for c in NODES.split(", ")])

    if len(label) == 0:
        raise ValueError("no labelled rows to fit on")
    tasks = min(trees, spark.sparkContext.defaultParallelism * 2)
    spark.range(0, trees, 1, tasks).mapInArrow(grow, NODES).write.parquet(f"{folder}/nodes")
    matrix.unpersist()
    return Forest(vocab, folder, title_col, text_col)
