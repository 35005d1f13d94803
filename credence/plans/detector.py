"""The unsupervised cluster detector end to end.

fit:   articles -> cleaned uni+bigram terms -> counts by term -> top-K
       vocabulary (collected, K rows) -> sparse rows of vocabulary ids and
       counts (kept; the large uni+bigram table never is) -> L2 TF-IDF
       -> population scaler (K rows) -> k-means rounds on the sparse rows
       -> distance statistics and fake ratio per cluster (k rows)
score: the same features for any articles, nearest centroid, z-score of the
       distance within its cluster, logistic penalty, combined score.

Driver-side state is bounded by construction: K vocabulary terms, K moments,
k x K centroid values and k cluster rows.  Every per-document step is a
DataFrame job.  Scoring is row-local (no shuffle, batch and stream alike);
``score_long`` does the same by explode, join and aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions.text import NULL_TEXT, clean_words, ngrams_1_2, weighted_text
from credence.operators import clusters as C
from credence.operators import kmeans as KM
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.session import materialize, reuse

# K-means settings (seed, iteration cap, tolerance).
KMEANS_SEED = 42
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4
# End of fixed values.

SCORE_COLUMNS = ("doc_id", "cluster", "predicted_fake", "margin_confidence", "z_score",
                 "fake_score", "cluster_fake_ratio", "distance")


@dataclass
class ClusterDetector:
    vocab: X.Vocabulary
    scaler: X.Scaler
    centroids: C.Centroids
    stats: list[dict]                 # one dict per cluster
    max_features: int = X.DETECTOR_MAX_FEATURES
    min_df: int = X.DETECTOR_MIN_DF
    title_weight: int = 2
    null_as: str = NULL_TEXT
    center: float = L.PENALTY_CENTER
    rounds: int = 0                   # k-means rounds run
    settled: bool = True              # whether the centroids had stopped moving

    @property
    def k(self) -> int:
        return self.centroids.k

    # ------------------------------------------------------------------ fit
    @classmethod
    def fit(cls, articles: DataFrame, k: int | None = None,
            max_features: int = X.DETECTOR_MAX_FEATURES, min_df: int = X.DETECTOR_MIN_DF,
            seed: int = KMEANS_SEED, max_iter: int = KMEANS_MAX_ITER, tol: float = KMEANS_TOL,
            title_weight: int = 2, null_as: str = NULL_TEXT,
            class_means: bool = False) -> tuple["ClusterDetector", DataFrame]:
        """Fit on ``articles(doc_id, title, text, is_fake)``.

        With ``class_means`` the centroids are the means of the two classes
        (cluster 0: not fake, 1: fake) in place of k-means clusters.
        ``max_iter`` bounds the k-means rounds; ``settled`` on the model says
        whether they ended by themselves.
        Returns the model and the in-sample scores of the training articles.
        """
        spark = articles.sparkSession
        docs = articles.select("doc_id", "title", "text", "is_fake")
        n_docs = docs.count()
        if n_docs == 0:
            raise ValueError("no articles to fit on")
        k = k or C.choose_k(n_docs)
        terms = X.detector_terms(docs, keep=("is_fake",), title_weight=title_weight, null_as=null_as)
        vocab = X.fit_vocabulary(X.term_frequencies(terms), n_docs, max_features, min_df)
        sparse = reuse(VF.sparse_counts(terms, vocab))
        try:
            weights = VF.long_weights(sparse, vocab, ("is_fake",))
            scaler = X.fit_scaler(weights, n_docs, len(vocab))
            if class_means:
                centroids = C.fit_class_mean_centroids(X.scaled_weights(weights, scaler.to_df(spark)), docs, len(vocab))
                rounds, settled = 0, True
            else:
                fit = KM.fit_kmeans(sparse, vocab, scaler, k, seed, max_iter, tol)
                centroids, rounds, settled = fit.centroids, fit.rounds, fit.settled
            assigned = materialize(KM.nearest(sparse, vocab, scaler, centroids).select("doc_id", "is_fake", "cluster", "distance"))
        finally:
            sparse.unpersist()
        stats = [r.asDict() for r in C.cluster_distance_stats(assigned).collect()]   # k rows
        model = cls(vocab, scaler, centroids, stats, max_features, min_df, title_weight, null_as, rounds=rounds, settled=settled)
        return model, model._score_assigned(assigned)

    # ---------------------------------------------------------------- score
    def stats_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(int(s["cluster"]), int(s["size"]), float(s["mean"]), float(s["std"] or 0.0),
              float(s["max"]), float(s["fake_ratio"])) for s in self.stats],
            "cluster int, size bigint, mean double, std double, max double, fake_ratio double")

    def _score_assigned(self, assigned: DataFrame) -> DataFrame:
        scored = C.score_assigned(assigned, self.stats_df(assigned.sparkSession), self.center)
        return scored.select(*SCORE_COLUMNS)

    def _terms(self, articles: DataFrame) -> DataFrame:
        return X.detector_terms(articles, keep=(), title_weight=self.title_weight,
                                null_as=self.null_as)

    def score(self, articles: DataFrame) -> DataFrame:
        """Score ``articles(doc_id, title, text)`` row by row: the score columns."""
        return self.score_vectors(articles.select("doc_id", "title", "text")).select(*SCORE_COLUMNS)

    def score_long(self, articles: DataFrame) -> DataFrame:
        """The same scores in long form: terms exploded, joined and aggregated by document."""
        spark = articles.sparkSession
        tf = X.term_frequencies(self._terms(articles))
        weights = X.tfidf_weights(tf, self.vocab.to_df(spark))
        scaled = X.scaled_weights(weights, self.scaler.to_df(spark))
        d2 = C.squared_distances(scaled, articles.select("doc_id"), self.centroids)
        return self._score_assigned(C.assign_nearest(d2))

    def score_vectors(self, articles: DataFrame) -> DataFrame:
        """Every input column and the score columns, row by row (no shuffle); works on streams too.

        An input column of the same name as a score column is replaced.  A
        row's vocabulary terms become a short list of ids; idf, scales and
        centroids are array literals that the ids index, and the k-row cluster
        statistics are a broadcast equi-join on ``cluster``.
        """
        doc = weighted_text("title", "text", title_weight=self.title_weight, null_as=self.null_as)
        # The caller's row travels in one struct, so its names cannot meet the internal ones.
        row = F.struct(*[F.col(f"`{c}`") for c in articles.columns])
        with_terms = articles.select(row.alias("_row"), clean_words(doc).alias("_words")).select("_row", ngrams_1_2(F.col("_words")).alias("_terms"))
        sparse = VF.sparse_counts(with_terms, self.vocab, "_terms")
        assigned = KM.nearest(sparse, self.vocab, self.scaler, self.centroids).drop(VF.IDS, VF.COUNTS)
        scored = C.score_assigned(assigned, self.stats_df(articles.sparkSession), self.center)
        added = [c for c in SCORE_COLUMNS if c != "doc_id"]
        return scored.select(*[F.col("_row").getField(c).alias(c) for c in articles.columns if c not in added], *added)

    def predict_one(self, spark: SparkSession, title: str | None, text: str | None) -> dict:
        """Score one article -> {cluster, is_fake, confidence, z_score, fake_score,
        cluster_fake_ratio} (the same scorer on a one-row frame)."""
        one = spark.createDataFrame([(0, title, text)], "doc_id bigint, title string, text string")
        r = self.score(one).collect()[0]
        return {"cluster": r["cluster"], "is_fake": r["predicted_fake"],
                "confidence": r["margin_confidence"], "z_score": r["z_score"],
                "fake_score": r["fake_score"], "cluster_fake_ratio": r["cluster_fake_ratio"]}

    # ----------------------------------------------------------- persistence
    def save(self, path: str, spark: SparkSession) -> None:
        w = lambda df, name: df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        w(self.vocab.to_df(spark), "vocab")
        w(self.scaler.to_df(spark), "scaler")
        w(self.centroids.long_df(spark), "centroids")
        w(self.stats_df(spark), "cluster_stats")
        w(spark.createDataFrame(
            [(self.k, self.vocab.n_docs, len(self.vocab), self.max_features, self.min_df,
              self.title_weight, self.null_as, self.center)],
            "k int, n_docs bigint, n_features int, max_features int, min_df int, "
            "title_weight int, null_as string, center double"), "params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClusterDetector":
        p = spark.read.parquet(f"{path}/params").collect()[0]
        voc = sorted(spark.read.parquet(f"{path}/vocab").collect(), key=lambda r: r["term_id"])
        vocab = X.Vocabulary(tuple(r["term"] for r in voc), tuple(r["df"] for r in voc),
                             tuple(r["n"] for r in voc), int(p["n_docs"]))
        sc = sorted(spark.read.parquet(f"{path}/scaler").collect(), key=lambda r: r["term_id"])
        scaler = X.Scaler(tuple(r["mean"] for r in sc), tuple(r["std"] for r in sc),
                          tuple(r["scale"] for r in sc))
        centroids = C.Centroids.from_long(spark.read.parquet(f"{path}/centroids").collect(),
                                          int(p["k"]), int(p["n_features"]))
        stats = [r.asDict() for r in spark.read.parquet(f"{path}/cluster_stats").collect()]
        return cls(vocab, scaler, centroids, stats, int(p["max_features"]), int(p["min_df"]),
                   int(p["title_weight"]), p["null_as"], float(p["center"]))
