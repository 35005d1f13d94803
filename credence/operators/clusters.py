"""Nearest-centroid assignment, distance statistics and the anomaly-adjusted
cluster score (K2-K7, A7-A9, J3-J4).

Vectors are the sparse, uncentred scaled TF-IDF rows ``v = w / scale`` in
long form (doc_id, term_id, v).  Squared distance to centroid c (same space):

    d^2(v, c) = sum(v^2) - 2 sum(v * c) + sum(c^2)

so only the document's non-zero terms are touched.  Centroids are a
bounded k x K table (k <= a handful, K = max_features); they are turned into
one row per term holding all k values and broadcast.  A single grouped
aggregation on ``doc_id`` then yields every document's k squared distances;
documents with no in-vocabulary term are added from the article list by a
union, so they get d^2 = sum(c^2) instead of vanishing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.session import check_broadcast_size

# Cluster-count rule k = min(8, max(3, n // 1000)).
K_MIN, K_MAX, ROWS_PER_CLUSTER = 3, 8, 1000
# End of fixed values.

# Relative size under which a squared distance is rounding noise (a point
# sitting on its own centroid).
_D2_NOISE = 1e-9


def choose_k(n: int, lo: int = K_MIN, hi: int = K_MAX, per: int = ROWS_PER_CLUSTER) -> int:
    return min(hi, max(lo, n // per))


def choose_k_col(n: Column, lo: int = K_MIN, hi: int = K_MAX, per: int = ROWS_PER_CLUSTER) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(n / F.lit(per)).cast("bigint"))).cast("int")


@dataclass(frozen=True)
class Centroids:
    """k centroids over K features in the uncentred scaled space."""

    values: tuple[tuple[float, ...], ...]   # values[cluster][term_id]

    def __post_init__(self):
        n_features = len(self.values[0]) if self.values else 0
        check_broadcast_size(self.k * n_features, "centroid table")

    @property
    def k(self) -> int:
        return len(self.values)

    @property
    def sq_norms(self) -> tuple[float, ...]:
        return tuple(sum(x * x for x in c) for c in self.values)

    def long_df(self, spark: SparkSession) -> DataFrame:
        rows = [(j, i, float(x)) for j, c in enumerate(self.values)
                for i, x in enumerate(c) if x != 0.0]
        return spark.createDataFrame(rows, "cluster int, term_id int, value double")

    def by_term_df(self, spark: SparkSession) -> DataFrame:
        """(term_id, c ARRAY<DOUBLE>): one row per feature with its k values."""
        n_features = len(self.values[0]) if self.values else 0
        rows = [(i, [float(c[i]) for c in self.values]) for i in range(n_features)]
        return spark.createDataFrame(rows, "term_id int, c array<double>")

    @classmethod
    def from_long(cls, rows, k: int, n_features: int) -> "Centroids":
        vals = [[0.0] * n_features for _ in range(k)]
        for r in rows:
            vals[int(r["cluster"])][int(r["term_id"])] = float(r["value"])
        return cls(tuple(tuple(v) for v in vals))


def class_mean_centroids_df(scaled: DataFrame, articles: DataFrame,
                            class_col: str = "is_fake") -> DataFrame:
    """(cluster, term_id, value): mean of ``v`` over the documents of each class.

    ``cluster`` is the class as an int (0 = false, 1 = true).  The divisor is
    the class size including documents without any vocabulary term.
    """
    sizes = (articles.groupBy(F.col(class_col).cast("int").alias("cluster"))
             .agg(F.count(F.lit(1)).alias("size")))
    sums = (scaled.groupBy(F.col(class_col).cast("int").alias("cluster"), "term_id")
            .agg(F.sum("v").alias("s")))
    # ``sizes`` has one row per class: a bounded broadcast.
    return (sums.join(F.broadcast(sizes), "cluster")
            .select("cluster", "term_id", (F.col("s") / F.col("size")).alias("value")))


def fit_class_mean_centroids(scaled: DataFrame, articles: DataFrame, n_features: int,
                             class_col: str = "is_fake") -> Centroids:
    rows = class_mean_centroids_df(scaled, articles, class_col).collect()  # <= 2 x K rows
    return Centroids.from_long(rows, 2, n_features)


def squared_distance(vv: Column, dot: Column, sq_norm: float) -> Column:
    """|v - c|^2 from |v|^2, v.c and |c|^2; rounding noise counts as 0."""
    raw = vv - F.lit(2.0) * dot + F.lit(float(sq_norm))
    return F.when(raw <= F.lit(_D2_NOISE) * (vv + F.lit(float(sq_norm))), F.lit(0.0)).otherwise(raw)


def squared_distances(scaled: DataFrame, articles: DataFrame, centroids: Centroids,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, d2 ARRAY<DOUBLE>): squared distance to each centroid.

    ``scaled`` is (doc_id, *keep, term_id, v); ``articles`` lists every
    document as (doc_id, *keep).  ``keep`` columns must be functions of
    ``doc_id`` (e.g. the label); they ride along the grouping key.
    """
    spark = scaled.sparkSession
    k = centroids.k
    cvec = F.broadcast(centroids.by_term_df(spark))           # K rows, bounded
    terms = (scaled.join(cvec, "term_id")
             .select("doc_id", *keep, (F.col("v") * F.col("v")).alias("vv"),
                     *[(F.col("v") * F.col("c")[j]).alias(f"dot{j}") for j in range(k)]))
    empty = articles.select("doc_id", *keep, F.lit(0.0).alias("vv"),
                            *[F.lit(0.0).alias(f"dot{j}") for j in range(k)])
    sums = (terms.unionByName(empty)
            .groupBy("doc_id", *keep)
            .agg(F.sum("vv").alias("vv"), *[F.sum(f"dot{j}").alias(f"dot{j}") for j in range(k)]))
    d2 = [squared_distance(F.col("vv"), F.col(f"dot{j}"), cc) for j, cc in enumerate(centroids.sq_norms)]
    return sums.select("doc_id", *keep, F.array(*d2).alias("d2"))


def assign_nearest(d2: DataFrame) -> DataFrame:
    """Adds ``cluster`` (lowest id on ties) and ``distance`` to its centroid."""
    dmin = F.array_min("d2")
    return (d2.withColumn("cluster", (F.array_position("d2", dmin) - 1).cast("int"))
            .withColumn("distance", F.sqrt(dmin))
            .drop("d2"))


def cluster_distance_stats(assigned: DataFrame, class_col: str = "is_fake") -> DataFrame:
    """(cluster, size, mean, std, max, fake_ratio): population std of distances."""
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("distance").alias("mean"),
        F.stddev_pop("distance").alias("std"),
        F.max("distance").alias("max"),
        F.avg(F.col(class_col).cast("double")).alias("fake_ratio"))


def score_assigned(assigned: DataFrame, stats: DataFrame,
                   center: float = L.PENALTY_CENTER) -> DataFrame:
    """Anomaly-adjusted score per document.

    ``stats`` has one row per cluster (k rows) and is broadcast.  The join is
    a left join: an article whose nearest centroid had no training members
    keeps its row, with NULL statistics and score, and is not fake.
    """
    s = F.broadcast(stats.select("cluster", F.col("mean").alias("_mean"),
                                 F.col("std").alias("_std"),
                                 F.col("fake_ratio").alias("cluster_fake_ratio")))
    j = assigned.join(s, "cluster", "left")
    z = L.zscore("distance", "_mean", "_std")
    out = j.withColumn("z_score", z)
    out = out.withColumn("fake_score", L.fake_score("cluster_fake_ratio",
                                                    L.logistic_penalty("z_score", center)))
    return (out.withColumn("predicted_fake", L.decide("fake_score"))
            .withColumn("margin_confidence", L.margin_confidence("fake_score"))
            .drop("_mean", "_std"))
