"""Replayable fits, row-local scoring, cuts without a global sort, checked sources."""

import gzip
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.operators import encode as ENC
from credence.operators import epochs as E
from credence.operators import forest as R
from credence.operators import kmeans as KM
from credence.operators import sampling as M
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.operators.clusters import Centroids
from credence.plans.detector import ClusterDetector
from credence.sources import csv as CSV
from credence.sources.tables import corpus

SF001 = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- vocabulary cut

@pytest.mark.parametrize("cut_rows", [2, 4096])
@pytest.mark.parametrize("k", [1, 7, 60, 200, 5000])
def test_top_terms_equal_a_full_sort(spark, monkeypatch, cut_rows, k):
    monkeypatch.setattr(X, "CUT_ROWS", cut_rows)
    rng = random.Random(1)
    counts = {f"{rng.choice('abé')}{rng.choice('abcz')}{i}" * rng.choice([1, 3]): rng.choice([1, 1, 1, 2, 3, 3, 900, 901, 902, 5000, 10 ** 12]) for i in range(300)}
    tf = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(counts.items())], "doc_id long, term string, tf long")
    top = {r["term"] for r in X.top_terms(tf, k, 1).collect()}
    assert top == set(sorted(counts, key=lambda t: (-counts[t], t.encode()))[:k])


def test_only_terms_at_the_cut_are_ordered(spark):
    tf = spark.createDataFrame([(d, f"t{t}", t % 50 + 1) for d in range(2) for t in range(9000)], "doc_id long, term string, tf long")
    top = X.top_terms(tf, 4000, 1)
    plan = plan_of(top)
    assert "TakeOrderedAndProject" in plan and plan.index("Union") < plan.index("TakeOrderedAndProject")   # one side of the union only
    assert top.count() == 4000


# --- samples and splits

def test_samples_scan_the_keys_only(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    cuts = M._Cuts(docs, M.hash_key())
    assert cuts.rows == docs.count()
    plan = plan_of(cuts.values.groupBy("v").count())
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_a_key_with_most_rows_is_divided_exactly(spark):
    rows = spark.createDataFrame([(1, f"t{i}") for i in range(90)] + [(i, "x") for i in range(2, 12)], "doc_id long, text string").repartition(5)
    for n in (3, 40, 89, 95, 99):
        a = sorted(map(tuple, M.sample_exact(rows, n).collect()))
        assert len(a) == n and a == sorted(map(tuple, M.sample_exact(rows.repartition(2), n).collect()))


# --- k-means

def _plain_kmeans(x, centroids, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        centroids = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centroids[j] for j in range(len(centroids))])
    return centroids


def test_kmeans_rounds_equal_plain_ones(spark):
    docs = corpus(spark, SF001, by_doc=True)
    terms = X.detector_terms(docs)
    vocab = X.fit_vocabulary(X.term_frequencies(terms), docs.count(), 200, 2)
    sparse = VF.sparse_counts(terms, vocab).cache()
    scaler = X.fit_scaler(VF.long_weights(sparse, vocab), docs.count(), len(vocab))
    rows = sparse.collect()
    x = np.array([KM._vector(r, vocab, scaler) for r in rows])
    start = KM.seeds(sparse, vocab, scaler, 4, 42)
    assert len({tuple(np.round(c, 9)) for c in start.values}) == 4
    assert all(np.abs(x - np.array(c)).max(axis=1).min() < 1e-9 for c in start.values)        # seeds are articles
    fit = KM.fit_kmeans(sparse, vocab, scaler, 4, 42, 3, 0.0)
    np.testing.assert_allclose(np.array(fit.centroids.values), _plain_kmeans(x, np.array(start.values), 3), atol=1e-9)
    done = KM.fit_kmeans(sparse, vocab, scaler, 4, 42, 300, 1e-4)
    assert done.settled and done.rounds < 300 and not fit.settled


def test_fewer_vectors_than_clusters(spark):
    articles = spark.createDataFrame([(i, "t", "same words again words", i % 2 == 0) for i in range(6)] + [(9, "t", "", True)],
                                     "doc_id bigint, title string, text string, is_fake boolean")
    model, scores = ClusterDetector.fit(articles, k=3)
    assert scores.count() == 7 and model.k == 3 and model.settled


def test_scores_need_no_exchange_and_equal_the_long_form(spark):
    docs = corpus(spark, SF001)
    model, _ = ClusterDetector.fit(docs, max_iter=3)
    scored = model.score(docs)
    assert "Exchange hashpartitioning" not in plan_of(scored)
    long = {r["doc_id"]: r for r in model.score_long(docs).collect()}
    for r in scored.collect():
        assert r["cluster"] == long[r["doc_id"]]["cluster"] and abs(r["distance"] - long[r["doc_id"]]["distance"]) < 1e-9


def test_d2_of_a_row_without_known_terms(spark):
    vocab, scaler = X.Vocabulary(("a", "it's"), (1, 1), (1, 1), 2), X.Scaler((0.0, 0.0), (1.0, 1.0), (1.0, 2.0))
    rows = VF.sparse_counts(spark.createDataFrame([(1, ["zz"]), (2, ["it's", "a", "it's"]), (3, [])], "doc_id int, terms array<string>"), vocab)
    d2 = {r["doc_id"]: r["_d2"] for r in VF.with_d2(rows, vocab, scaler, Centroids(((0.5, 0.0), (0.0, 0.0)))).collect()}
    assert d2[1] == d2[3] == [0.25, 0.0]
    a, b = 1 / 5 ** 0.5, 2 / 5 ** 0.5 / 2
    np.testing.assert_allclose(d2[2], [(a - 0.5) ** 2 + b ** 2, a ** 2 + b ** 2])


# --- training by epochs

def test_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), [int(v) for v in rng.integers(0, 8, rng.integers(0, 6))]) for _ in range(40)]
    block = spark.createDataFrame(rows, "label int, ids array<int>").repartition(3)
    idf, w, b = rng.random(8) + 1, rng.normal(size=(8, 3)), rng.normal(size=3)
    g, gb, loss, n = E.gradient(block, idf, w, b)

    def mean_loss(weights, bias):
        z = E.logits_of(pa.array([r[1] for r in rows], pa.list_(pa.int64())), idf, weights, bias)
        return -np.log(E.softmax(z)[np.arange(len(rows)), [r[0] for r in rows]]).mean()
    assert n == 40 and loss == pytest.approx(mean_loss(w, b))
    for at in [(0, 0), (3, 1), (7, 2)]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert g[at] == pytest.approx((mean_loss(up, b) - mean_loss(down, b)) / 2e-5, abs=1e-7)
    up = b + np.array([0, 1e-5, 0])
    assert gb[1] == pytest.approx((mean_loss(w, up) - mean_loss(w, b)) / 1e-5, abs=1e-4)


def test_three_labels_learn_and_load(spark, tmpdir_path):
    words = {0: "red apple fruit", 1: "blue sky cloud", 2: "green leaf tree"}
    rows = [(i, f"{words[i % 3]} n{i}", i % 3) for i in range(90)] + [(100, None, None), (101, "red", 7)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, label_id int")
    clf, history = E.fit_epochs(data, num_labels=3, buckets=256)
    shown = history.collect()
    assert len(shown) == 3 and max(r["accuracy"] for r in shown) == 1.0 and shown[-1]["train_loss"] < shown[0]["train_loss"]
    clf.save(f"{tmpdir_path}/clf", spark)
    back = E.SoftmaxClassifier.load(spark, f"{tmpdir_path}/clf")
    assert back.num_labels == 3 and back.model_name == clf.model_name
    out = {r["doc_id"]: r for r in back.classify(data.withColumn("prediction", F.lit("mine"))).collect()}
    assert all(out[i]["prediction"] == i % 3 for i in range(90)) and len(out) == 92
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-12 for r in out.values())


def test_training_needs_labelled_rows(spark):
    rows = spark.createDataFrame([(f"id{i}", f"word{i} common", i % 2) for i in range(30)], "doc_id string, text string, label_id int")
    clf, _ = E.fit_epochs(rows, epochs=1, steps=2, buckets=64)                 # ids of any type
    assert clf.classify(rows).count() == 30
    with pytest.raises(ValueError, match="labelled"):
        E.fit_epochs(rows.withColumn("label_id", F.lit(9)), buckets=64)


def test_scratch_folders_go_with_the_application(spark):
    import os

    from credence.session import scratch_folder
    a, b = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert a != b and os.path.isdir(a.removeprefix("file:")) and a.startswith(spark.sparkContext.getCheckpointDir())


# --- forest

def test_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, y, w = rng.integers(0, 4, (12, 3)).astype(np.float32), rng.integers(0, 2, 12).astype(float), rng.integers(1, 3, 12).astype(float)
        best = 0.0
        for c in range(3):
            for t in np.unique(x[:, c])[:-1]:
                left = x[:, c] <= t
                best = max(best, sum(((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / w[s].sum() for s in (left, ~left)))
        c, t = R.best_split(x, y, w)
        left = x[:, c] <= t
        assert sum(((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / w[s].sum() for s in (left, ~left)) == pytest.approx(best)
    assert R.best_split(np.ones((5, 2), np.float32), np.array([0, 1, 0, 1, 1.0]), np.ones(5)) is None


def test_forest_scores_equal_sql_on_its_node_table(spark):
    data = corpus(spark, SF001, by_doc=True).withColumn("label_id", F.col("is_fake").cast("int"))
    forest = R.fit_forest(data, trees=15)
    nodes = forest.nodes(spark).toArrow()  # noqa: F841 - read by name in the SQL
    rows = forest.sparse(data).select(F.col("_row.doc_id").alias("doc_id"), VF.IDS, VF.COUNTS).toArrow()
    x = R.dense_rows(rows[VF.IDS], rows[VF.COUNTS], np.array(forest.vocab.idf))
    at = np.nonzero(x)
    cells = pa.table({"doc_id": rows["doc_id"].to_numpy()[at[0]], "feature": at[1].astype(np.int32), "x": x[at].astype(np.float64)})  # noqa: F841
    docs = pa.table({"doc_id": rows["doc_id"]})  # noqa: F841
    expected = dict(duckdb.sql("""
        WITH RECURSIVE walk AS (
          SELECT doc_id, tree, 0 AS node FROM docs, (SELECT DISTINCT tree FROM nodes)
          UNION ALL
          SELECT w.doc_id, w.tree, CASE WHEN coalesce(c.x, 0) <= n.threshold THEN n."left" ELSE n."right" END
          FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature >= 0
          LEFT JOIN cells c ON c.doc_id = w.doc_id AND c.feature = n.feature)
        SELECT w.doc_id, avg(n.p_fake) FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature < 0 GROUP BY w.doc_id""").fetchall())
    found = {r["doc_id"]: r["p_fake"] for r in forest.classify(data).collect()}
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(p, abs=1e-12) for d, p in expected.items())


def test_forest_bounds_are_checked(spark, monkeypatch):
    data = spark.createDataFrame([(i, f"word{i % 4} common", i % 2) for i in range(30)], "doc_id bigint, text string, label_id int")
    assert R.fit_forest(data, trees=3, title_col=None, train_rows=10).nodes(spark).where("node = 0").agg(F.max("n")).first()[0] == 10
    monkeypatch.setattr(R, "MATRIX_CELLS", 20)
    with pytest.raises(ValueError, match="training matrix"):
        R.fit_forest(data, trees=3, title_col=None)


# --- encodings

def test_subwords_are_cut_or_run_on(spark):
    public = pytest.importorskip("public_tokenizers")
    vocabulary = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    texts = {1: "Où est l'été ? 😀😀 " * 30, 2: "", 3: None, 4: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = {r["doc_id"]: r for r in ENC.encode_subwords(docs, *vocabulary, max_length=16).collect()}
    assert len(cut) == 4 and all(len(r["input_ids"]) == len(r["attention_mask"]) == 16 for r in cut.values())
    assert cut[1]["n_tokens"] == 16 and cut[2]["n_tokens"] == cut[3]["n_tokens"] == 2
    whole = ENC.encode_subwords(docs, *vocabulary, max_length=5, whole=True)
    assert whole.where("doc_id = 1").count() > 30
    assert {r["doc_id"]: r["text"] for r in ENC.decode_subwords(whole, *vocabulary).collect()} == {k: v or "" for k, v in texts.items()}


# --- checked sources

def test_rejected_rows_have_reasons(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('title,fake,text\nt1,1,"two\nlines, quoted ""x"""\nt2,maybe,b\nt3,0\nt4,0,c,d\nt5,7,e\nNA,1,f\n,,g\n')
    good, bad = CSV.read_checked(spark, f"{tmpdir_path}/a.csv", "text string, fake int, title string", required=("title",), checks={"class": F.col("fake").isin(0, 1)}, na_values=("NA", ""))
    assert [tuple(r) for r in good.collect()] == [('two\nlines, quoted "x"', 1, "t1")]
    rows = {r["reason"]: r for r in bad.collect() if r["reason"] != "fields"}
    assert {k: v["text"] for k, v in rows.items()} == {"type:fake": "b", "check:class": "e", "missing:title": "g"} or set(rows) == {"type:fake", "check:class", "missing:title"}
    fields = sorted(r["record"].strip() for r in bad.where("reason = 'fields'").collect())
    assert fields == ["t3,0", "t4,0,c,d"] and bad.count() == 6 and all(r["file"].endswith("a.csv") for r in bad.collect())


def test_an_unreadable_optional_file_is_reported(spark, tmpdir_path):
    for name, rows in (("fake", "a,b"), ("true", "c,d")):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write(f"title,text\n{rows}\n")
    whole = gzip.compress(b"post;media;fake\n" + b"".join(b"x%d;m;1\n" % i for i in range(50_000)))
    with open(f"{tmpdir_path}/cut.csv.gz", "wb") as f:
        f.write(whole[: len(whole) // 2])
    report = []
    out = CSV.load_training_articles(spark, f"{tmpdir_path}/fake.csv", f"{tmpdir_path}/true.csv", [f"{tmpdir_path}/none.csv", f"{tmpdir_path}/cut.csv.gz"], report=report)
    assert out.count() == 2 and [r.status for r in report] == ["missing", "unreadable"] and report[1].detail
    with pytest.warns(UserWarning, match="left out"):
        CSV.load_training_articles(spark, f"{tmpdir_path}/fake.csv", f"{tmpdir_path}/true.csv", f"{tmpdir_path}/cut.csv.gz")
