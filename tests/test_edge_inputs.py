"""Inputs that the test tables do not hold: constant features, null texts, odd CSV rows, clashing names, empty clusters."""

import math

import pytest
from pyspark.sql import functions as F

from credence.operators import classify as K
from credence.operators import clusters as C
from credence.operators import evaluate as V
from credence.operators import tfidf as X
from credence.sources import csv as CSV


@pytest.mark.parametrize("weight, n", [(0.7, 100), (0.57735, 1000)])
def test_constant_feature_has_scale_one(spark, weight, n):
    w = spark.range(n, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit(0).alias("term_id"), F.lit(weight).alias("weight"))
    r = X.feature_moments(w, n).first()
    assert r["scale"] == 1.0 and r["std"] == pytest.approx(0.0, abs=1e-12) and r["mean"] == pytest.approx(weight)


def test_moments_count_documents_without_the_term(spark):
    values = [0.3, 0.9, 0.4]
    w = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "doc_id int, term_id int, weight double")
    r = X.feature_moments(w, 8).first()
    whole = values + [0.0] * 5
    mean = sum(whole) / 8
    assert r["mean"] == pytest.approx(mean)
    assert r["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in whole) / 8))


def test_cluster_without_members_is_not_fake(spark):
    assigned = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "doc_id int, cluster int, distance double")
    stats = spark.createDataFrame([(0, 1.0, 0.5, 1.0)], "cluster int, mean double, std double, fake_ratio double")
    rows = {r["doc_id"]: r for r in C.score_assigned(assigned, stats).collect()}
    assert rows[1]["predicted_fake"] is True
    assert rows[2]["predicted_fake"] is False and rows[2]["fake_score"] is None


def test_accuracy_counts_a_null_prediction_as_wrong(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (None, None), (0, 1)], "prediction int, truth int")
    r = V.accuracy(df).first()
    assert (r["n"], r["correct"], r["accuracy"]) == (4, 1, 0.25)


def test_csv_schema_goes_by_name(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("text,n,title\nbody1,1,head1\nbody2,2,head2\n")
    rows = CSV.read_articles(spark, str(p), schema="title string, n int, text string").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("head1", 1, "body1"), ("head2", 2, "body2")]
    with pytest.raises(ValueError, match="absent"):
        CSV.read_articles(spark, str(p), schema="title string, absent string")


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("bad", ["head2,body2,surplus", "head2"])
def test_csv_rows_of_another_length(spark, tmp_path, bad, multi_line):
    p = tmp_path / "a.csv"
    p.write_text(f"title,text\nhead1,body1\n{bad}\n")
    for columns in ("title string, text string", "title string"):
        with pytest.raises(Exception):
            CSV.read_articles(spark, str(p), schema=columns, multi_line=multi_line).collect()
    loose = CSV.read_articles(spark, str(p), multi_line=multi_line, strict=False).orderBy("title").collect()
    assert [r["title"] for r in loose] == ["head1", "head2"]


def test_csv_unreadable_value(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("n\n1\nx\n")
    with pytest.raises(Exception):
        CSV.read_articles(spark, str(p), schema="n int").collect()
    assert {r["n"] for r in CSV.read_articles(spark, str(p), schema="n int", strict=False).collect()} == {1, None}


def test_french_file_is_optional(spark, tmp_path):
    for name, text in (("fake", "title,text\na,b\n"), ("true", "title,text\nc,d\n"),
                       ("odd", "post;media\nx;y\n"), ("fr", "post;media;fake\np;m;1\nq;m;what\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda fr: CSV.load_training_articles(spark, str(tmp_path / "fake.csv"), str(tmp_path / "true.csv"), str(tmp_path / fr))
    assert read("odd.csv").count() == read("gone.csv").count() == 2
    assert read("fr.csv").count() == 4


def test_classifier_takes_null_texts_and_clashing_names(spark):
    train = spark.createDataFrame([(i, f"good news today {i}" if i % 2 else None if i == 4 else f"shocking secret hoax {i}", 1 - i % 2) for i in range(20)],
                                  "doc_id int, text string, label_id int")
    clf = K.fit_forest(train, title_col=None, trees=3, max_depth=3)
    rows = spark.createDataFrame([(1, "shocking hoax", "mine", [1], "p", 9), (2, None, None, None, None, None)],
                                 "doc_id int, text string, _mine string, terms array<int>, features string, prediction int")
    out = clf.classify(rows)
    assert out.columns == ["doc_id", "text", "_mine", "terms", "features", *K.ADDED]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["_mine"] == "mine" and got[1]["terms"] == [1] and got[1]["prediction"] in (0, 1)
    assert got[2]["text"] is None and got[2]["prediction"] in (0, 1)


def test_projections_do_not_shuffle_the_text(spark):
    from conftest import SF001
    from credence.plans.catalog import QUERIES
    for name in ("weighted_text", "optional_title_text", "clean_text", "bigram_counts", "harmonise_articles", "union_by_name"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan, name


def test_stats_record_with_and_without_unlabelled_datasets(spark):
    from credence.operators import profile as P
    df = spark.createDataFrame([("a", "FAKE")] * 4 + [("a", "REAL")] * 3 + [("b", None)], "dataset string, label string")
    whole, labelled = P.stats_record(df).first(), P.stats_record(df, skip_unlabelled=True).first()
    assert (whole["articles"], whole["fake_pct"], whole["true_pct"]) == (8, 50.0, 37.5)
    assert (labelled["articles"], labelled["fake_pct"], labelled["true_pct"]) == (7, 57.1, 42.9)
    assert [tuple(d) for d in whole["datasets"]] == [("a", 7, 4, 3), ("b", 1, None, None)]
    assert [d["name"] for d in labelled["datasets"]] == ["a"]
    empty = P.stats_record(df.limit(0)).first()
    assert empty["articles"] == 0 and empty["fake_pct"] is None and empty["datasets"] == []


def test_vector_scores_keep_columns_of_clashing_names(spark):
    from credence.plans.detector import ClusterDetector
    train = spark.createDataFrame([(i, "t", f"shocking hoax secret {i}" if i % 2 else f"good news today {i}", i % 2 == 1) for i in range(12)],
                                  "doc_id int, title string, text string, is_fake boolean")
    model, _ = ClusterDetector.fit(train, class_means=True, min_df=1)
    rows = train.selectExpr("*", "doc_id AS _terms", "'mine' AS d2", "doc_id AS _features_tf", "1 AS _mean", "'old' AS cluster")
    got = {r["doc_id"]: r for r in model.score_vectors(rows).collect()}
    assert all((r["_terms"], r["d2"], r["_features_tf"], r["_mean"]) == (i, "mine", i, 1) for i, r in got.items())
    plain = {r["doc_id"]: r["cluster"] for r in model.score_vectors(train).collect()}
    assert {i: r["cluster"] for i, r in got.items()} == plain == {i: i % 2 for i in range(12)}
