import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from credence.operators import clusters as C
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.plans.detector import ClusterDetector
from credence.sources.tables import corpus


def test_tied_vocabulary(spark):
    terms = [(i, [f"t{j}" for j in range(10)]) for i in range(3)]
    df = spark.createDataFrame(terms, "doc_id int, terms array<string>")
    vocab = X.fit_vocabulary(X.term_frequencies(df), 3, 4, 2)
    assert vocab.terms == ("t0", "t1", "t2", "t3")
    lazy = X.vocabulary_df(X.term_frequencies(df), 3, 4, 2).orderBy("term_id").collect()
    assert [r["term"] for r in lazy] == list(vocab.terms)
    assert math.isclose(lazy[0]["idf"], math.log(4 / 4) + 1)


def test_constant_feature_scale_one(spark):
    df = spark.createDataFrame([(i, ["same", f"u{i}", f"u{i}"]) for i in range(4)],
                               "doc_id int, terms array<string>")
    tf = X.term_frequencies(df)
    vocab = X.fit_vocabulary(tf, 4, 10, 1)
    w = X.tfidf_weights(tf, vocab.to_df(spark))
    sc = X.fit_scaler(w, 4, len(vocab))
    i = vocab.terms.index("same")
    assert sc.scale[i] == 1.0 and sc.std[i] < 1e-12
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0) for r in norms)


def _corpus_features(spark, sf):
    c = corpus(spark, sf, by_doc=True)
    n = c.count()
    terms = X.detector_terms(c)
    tf = X.term_frequencies(terms, keep=("is_fake",))
    vocab = X.fit_vocabulary(tf, n, 2000, 2)
    w = X.tfidf_weights(tf, vocab.to_df(spark), keep=("is_fake",))
    sc = X.fit_scaler(w, n, len(vocab))
    return c, terms, vocab, w, sc


def test_long_form_equals_vector_form(spark):
    c, terms, vocab, w, sc = _corpus_features(spark, SF001)
    scaled = X.scaled_weights(w, sc.to_df(spark))
    vec = VF.tfidf_vectors(vocab, "terms", "features", sc).transform(terms)
    dense = {r["doc_id"]: np.array(r["a"]) for r in
             vec.select("doc_id", vector_to_array("features").alias("a")).collect()}
    long = {}
    for r in scaled.collect():
        long.setdefault(r["doc_id"], np.zeros(len(vocab)))[r["term_id"]] = r["v"]
    assert set(long) <= set(dense)
    for d, arr in dense.items():
        np.testing.assert_allclose(arr, long.get(d, np.zeros(len(vocab))), atol=1e-12)


def test_sparse_distance_matches_dense(spark):
    c, terms, vocab, w, sc = _corpus_features(spark, SF001)
    scaled = X.scaled_weights(w, sc.to_df(spark))
    docs = c.select("doc_id", "is_fake")
    cent = C.fit_class_mean_centroids(scaled, docs, len(vocab))
    got = {r["doc_id"]: r for r in C.assign_nearest(
        C.squared_distances(scaled, docs, cent, keep=("is_fake",))).collect()}
    vec = VF.tfidf_vectors(vocab, "terms", "features", sc).transform(terms)
    mu = np.array(sc.mean) / np.array(sc.scale)
    cents = np.array(cent.values)
    for r in vec.select("doc_id", vector_to_array("features").alias("a")).collect():
        u = np.array(r["a"]) - mu                   # dense centred form
        d = np.linalg.norm(u[None, :] - (cents - mu[None, :]), axis=1)
        assert got[r["doc_id"]]["cluster"] == int(np.argmin(d))
        assert abs(got[r["doc_id"]]["distance"] - d.min()) < 1e-6
    assert len(got) == c.count()


def test_detector_fit_score_save_load(spark, tmpdir_path):
    c = corpus(spark, SF001, by_doc=True)
    model, scores = ClusterDetector.fit(c)
    assert model.k == 3
    s1 = {r["doc_id"]: r for r in scores.collect()}
    assert len(s1) == c.count()
    # every label is the nearest centroid; long form = vector form
    s2 = {r["doc_id"]: r for r in model.score(c).collect()}
    s3 = {r["doc_id"]: r for r in model.score_vectors(c).collect()}
    for d, r in s1.items():
        assert r["cluster"] == s2[d]["cluster"] == s3[d]["cluster"]
        assert abs(r["distance"] - s3[d]["distance"]) < 1e-6
        assert r["predicted_fake"] == s3[d]["predicted_fake"]
    one = model.score(c.limit(1).select("doc_id", "title", "text")).collect()   # K8: one article
    assert len(one) == 1 and set(one[0].asDict()) >= {"cluster", "predicted_fake", "z_score",
                                                        "fake_score", "margin_confidence"}
    rec = model.predict_one(spark, "A title", "Some article text about markets and elections")
    assert set(rec) == {"cluster", "is_fake", "confidence", "z_score", "fake_score", "cluster_fake_ratio"}
    assert rec["cluster"] in range(model.k) and isinstance(rec["is_fake"], bool)
    model.save(tmpdir_path, spark)
    back = ClusterDetector.load(spark, tmpdir_path)
    assert back.k == model.k and back.vocab == model.vocab
    s4 = {r["doc_id"]: r for r in back.score(c).collect()}
    for d, r in s2.items():
        assert r["cluster"] == s4[d]["cluster"]
        assert (math.isnan(r["fake_score"]) and math.isnan(s4[d]["fake_score"])) or \
            abs(r["fake_score"] - s4[d]["fake_score"]) < 1e-9


def test_result_invariant_under_repartition(spark):
    from credence.plans.catalog import QUERIES
    a = sorted(tuple(r) for r in QUERIES["score_articles"](spark, SF001).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(tuple(r) for r in QUERIES["score_articles"](spark, SF001).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_singleton_cluster_scores(spark):
    # one far-away point forms its own cluster: std = 0, z = NaN, not fake
    assigned = spark.createDataFrame([(1, 0, 0.0, True), (2, 1, 1.0, False), (3, 1, 3.0, True)],
                                     "doc_id int, cluster int, distance double, is_fake boolean")
    stats = C.cluster_distance_stats(assigned)
    out = {r["doc_id"]: r for r in C.score_assigned(assigned, stats).collect()}
    assert math.isnan(out[1]["z_score"]) and out[1]["predicted_fake"] is False
    assert out[2]["z_score"] == -1.0 and out[3]["z_score"] == 1.0


def test_streaming_equals_batch(spark, tmpdir_path):
    from credence.streaming import scoring as ST
    from credence.functions.text import synth_title
    c = corpus(spark, SF001, by_doc=True)
    model, _ = ClusterDetector.fit(c)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    stream = ST.article_stream(spark, f"{SF001}/documents.parque[t]", docs.schema) \
        .withColumn("title", synth_title("text"))
    ST.run_to_table(ST.score_stream(model, stream), f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    batch = {r["doc_id"]: r for r in model.score(docs.withColumn("title", synth_title("text"))).collect()}
    assert set(got) == set(batch)
    for d, r in batch.items():
        assert got[d]["cluster"] == r["cluster"] and abs(got[d]["distance"] - r["distance"]) < 1e-6
    ST.score_stream_to_table(model, stream, f"{tmpdir_path}/out2", f"{tmpdir_path}/ck2")
    got2 = {r["doc_id"]: r for r in spark.read.parquet(f"{tmpdir_path}/out2").collect()}
    assert set(got2) == set(batch)
    assert all(got2[d]["cluster"] == r["cluster"] for d, r in batch.items())


def test_per_document_steps_need_no_exchange(spark):
    """The corpus is hash-partitioned by doc_id once; term counts and the
    per-document L2 norm then plan without another shuffle."""
    from credence.session import reuse
    c = corpus(spark, SF001, by_doc=True)
    tf = X.term_frequencies(X.detector_terms(c, keep=("is_fake",)), keep=("is_fake",))
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1      # the corpus repartition only
    assert "Exchange hashpartitioning(doc_id#" in plan and plan.count("Exchange") == 2  # + label broadcast
    tfm = reuse(tf)
    vocab = X.fit_vocabulary(tfm, c.count(), 2000, 2)
    w = X.tfidf_weights(tfm, vocab.to_df(spark))
    wplan = w._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in wplan       # only the cached corpus repartition remains


def test_scores_keep_articles_of_memberless_clusters(spark):
    assigned = spark.createDataFrame([(1, 0, 1.0), (2, 5, 2.0)], "doc_id int, cluster int, distance double")
    stats = spark.createDataFrame([(0, 1.0, 0.5, 0.25)], "cluster int, mean double, std double, fake_ratio double")
    out = {r["doc_id"]: r for r in C.score_assigned(assigned, stats).collect()}
    assert set(out) == {1, 2} and out[2]["fake_score"] is None and out[1]["z_score"] == 0.0


def test_row_sums_by_batch(spark):
    """Sums of a row's terms, made for whole batches: the same numbers as term by term, and no lambda a term."""
    from credence.operators import vectors as VF
    rows = [(1, [0, 2], [1.0, 3.0]), (2, [], []), (3, [1], [2.0]), (4, [0, 1, 2], [0.1, 0.2, 0.7])]
    df = spark.createDataFrame(rows, "doc_id long, _ids array<int>, _counts array<double>").repartition(2)
    once, twice = [0.5, 0.25, 1.0 / 3], [1.5, 0.1, 0.7]
    got = {r[0]: r[1] for r in df.select("doc_id", VF.row_sums(once, twice, squared=(1,)).alias("s")).collect()}
    assert got == {d: [sum((c * once[i] for i, c in zip(ids, counts)), 0.0), sum((c * c * twice[i] for i, c in zip(ids, counts)), 0.0)] for d, ids, counts in rows}
    assert df.where("false").select(VF.row_sums(once)).collect() == []


def test_means_read_the_rows_once(spark, monkeypatch):
    from credence.operators import kmeans as KM
    from credence.operators import tfidf as X
    from credence.operators.clusters import Centroids
    rows = [(1, [0, 1], [1.0, 2.0], 0), (2, [1], [3.0], 0), (3, [0], [1.0], 1), (4, [], [], 1)]
    df = spark.createDataFrame(rows, "doc_id long, _ids array<int>, _counts array<double>, cluster int")
    vocab, scaler = X.Vocabulary(("a", "b"), (2, 2), (2, 5), 4), X.Scaler((0.0, 0.0), (1.0, 1.0), (0.5, 2.0))
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    means = KM.means(df, vocab, scaler, Centroids(((9.0, 9.0), (9.0, 9.0), (7.0, 8.0))))
    assert len(plans) == 1 and "Union" not in plans[0]
    vector = {r[0]: KM._vector({"_ids": r[1], "_counts": r[2]}, vocab, scaler) if r[1] else (0.0, 0.0) for r in rows}
    want = [[(vector[a][i] + vector[b][i]) / 2 for i in (0, 1)] for a, b in ((1, 2), (3, 4))] + [[7.0, 8.0]]
    assert [pytest.approx(w) for w in want] == [list(v) for v in means.values]
