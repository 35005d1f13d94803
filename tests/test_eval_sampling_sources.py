import math

import numpy as np
import pytest
from pyspark.sql import functions as F


from credence.operators import classify as K
from credence.operators import encode as E
from credence.operators import evaluate as V
from credence.operators import sampling as M
from credence.operators import tfidf as X
from credence.sources import csv as CSV
from credence.sources.examples import example_articles


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "prediction int, truth int")
    m = V.binary_metrics(df).collect()[0]
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    assert math.isclose(m["accuracy"], 2 / 3)


def test_tied_logits_argmax_first(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],)], "logits array<double>")
    r = V.with_softmax(df).collect()
    assert r[0]["prediction"] == 0 and math.isclose(r[0]["class_confidence"], 0.5)
    assert r[1]["prediction"] == 1 and math.isclose(sum(r[1]["probabilities"]), 1.0)


def test_batched_log_loss_and_best_epoch(spark):
    rows = [(i, 1, 0, [0.5, 0.5] if i < 8 else [0.9, 0.1]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id int, epoch int, truth int, probabilities array<double>")
    ll = V.log_loss(df, group="epoch", batch_size=8, order_col="vec_id").collect()[0]
    expected = (-math.log(0.5) + -math.log(0.9)) / 2        # mean of batch means
    assert math.isclose(ll["log_loss"], expected) and ll["batches"] == 2
    m = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, accuracy double")
    assert V.best_epoch(m).collect()[0]["best_epoch"] == 2


@pytest.mark.parametrize("n,val", [(9, 1), (10, 1), (11, 2), (30, 3)])
def test_split_sizes(spark, n, val):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    train, v = M.split_exact(df)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in v.collect()}
    assert len(b) == val == M.validation_size(n) and not (a & b) and len(a | b) == n


def test_split_single_row_raises(spark):
    with pytest.raises(ValueError):
        M.split_exact(spark.range(1).withColumnRenamed("id", "doc_id"))


def test_sample_is_the_smallest_keys(spark):
    import hashlib
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (1, 700, 4999):
        assert {r[0] for r in M.sample_exact(df, n).collect()} == set(order[:n])
    assert M.sample_exact(df, 10_000).count() == 5000


def test_global_positions(spark):
    from credence.operators.ranking import global_positions
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(0, 300, 3)], "g int, k int")
    got = global_positions(df, ["k"], "g", "pos").collect()
    assert all(r["pos"] == r["k"] // 3 for r in got) and len(got) == 200


def test_encode_fixed(spark):
    toks = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, []), (3, ["a"] * 20)],
                                 "doc_id int, terms array<string>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "term_id int, term string")
    out = {r["doc_id"]: r for r in E.encode_fixed(toks, vocab, max_length=8).collect()}
    assert out[1]["input_ids"] == [2, 4, 5, 1, 3, 0, 0, 0]
    assert out[1]["attention_mask"] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert out[2]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0] and out[2]["n_tokens"] == 2
    assert out[3]["input_ids"] == [2, 4, 4, 4, 4, 4, 4, 3] and sum(out[3]["attention_mask"]) == 8


def test_csv_quoting_na_and_fallback(spark, tmpdir_path):
    p = f"{tmpdir_path}/a.csv"
    with open(p, "w", encoding="utf-8") as f:
        f.write('title,text\n"He said ""hi"", ok","line1\nline2"\n,NA\nx,nan\n')
    df = CSV.read_articles(spark, p)
    rows = df.collect()
    assert rows[0]["title"] == 'He said "hi", ok' and rows[0]["text"] == "line1\nline2"
    assert rows[1]["text"] == "NA"
    rows2 = CSV.read_articles(spark, p, na_values=CSV.DEFAULT_NA_VALUES).collect()
    assert rows2[1]["text"] is None and rows2[2]["text"] is None
    got = CSV.read_first_available(spark, [f"{tmpdir_path}/missing.csv", p])
    assert got.count() == 3
    assert CSV.read_optional(spark, f"{tmpdir_path}/missing.csv") is None
    with pytest.raises(FileNotFoundError):
        CSV.read_first_available(spark, [f"{tmpdir_path}/missing.csv"])


def test_training_loader(spark, tmpdir_path):
    with open(f"{tmpdir_path}/fake.csv", "w") as f:
        f.write("title,text\nt1,alpha beta\nt2,gamma delta\n")
    with open(f"{tmpdir_path}/true.csv", "w") as f:
        f.write("title,text\nt3,epsilon zeta\n")
    with open(f"{tmpdir_path}/fr.csv", "w") as f:
        f.write("post;media;fake\nbonjour le monde;m1;1\nsalut;m2;0\n")
    arts = CSV.load_training_articles(spark, f"{tmpdir_path}/fake.csv", f"{tmpdir_path}/true.csv",
                                      f"{tmpdir_path}/fr.csv")
    rows = arts.collect()
    assert len(rows) == 5 and sum(r["is_fake"] for r in rows) == 3
    assert {r["lang"] for r in rows} == {"en", "fr"}
    assert len({r["doc_id"] for r in rows}) == 5
    only_en = CSV.load_training_articles(spark, f"{tmpdir_path}/fake.csv", f"{tmpdir_path}/true.csv",
                                         f"{tmpdir_path}/nope.csv")
    assert only_en.count() == 3
    with pytest.raises(FileNotFoundError):
        CSV.load_training_articles(spark, f"{tmpdir_path}/nope.csv", f"{tmpdir_path}/true.csv")


def test_forest_on_examples_and_roundtrip(spark, tmpdir_path):
    ex = example_articles(spark)
    clf = K.fit_forest(ex, trees=20, max_depth=10)
    out = clf.classify(ex).collect()
    assert all(0.0 <= r["class_confidence"] <= 1.0 and r["confidence_text"].endswith("%") for r in out)
    acc = np.mean([r["prediction"] == r["label_id"] for r in out])
    assert acc >= 0.9
    one = clf.classify(spark.createDataFrame([(99, "", "SHOCK: moon made of cheese!")],
                                             "doc_id bigint, title string, text string")).collect()
    assert len(one) == 1 and len(one[0]["probabilities"]) == 2            # X5: one text
    assert one[0]["class_confidence"] == max(one[0]["probabilities"])
    rec = clf.predict_one(spark, "URGENT: cats can fly!")
    assert rec["confidence"] == max(rec["probabilities"]) and rec["confidence_text"].endswith("%")
    clf.save(tmpdir_path, spark)
    back = K.Forest.load(spark, tmpdir_path)
    again = {r["doc_id"]: r["prediction"] for r in back.classify(ex).collect()}
    assert again == {r["doc_id"]: r["prediction"] for r in out}


def test_text_classifier_history(spark):
    ex = example_articles(spark)
    train = ex.filter(F.col("doc_id") % 5 != 0)
    val = ex.filter(F.col("doc_id") % 5 == 0)
    clf, hist = K.fit_epochs(train, val, epochs=2, keep="last")
    h = hist.orderBy("epoch").collect()
    assert [r["epoch"] for r in h] == [1, 2] and all(r["n"] == 4 for r in h)
    assert sum(r["best"] for r in h) == 1
    scored = clf.classify(val).select("prediction", F.col("label_id").alias("truth")).collect()
    assert sum(r["prediction"] == r["truth"] for r in scored) / 4 == h[-1]["accuracy"]


def test_user_batch_model(spark):
    ex = example_articles(spark)
    tokens = X.token_terms(ex)
    vocab = X.fit_vocabulary(X.term_frequencies(tokens), 20, 50, 1).to_df(spark)
    enc = E.encode_fixed(tokens, vocab, max_length=16)

    def make_predict_fn():
        def predict(ids):
            # "model": logit 1 grows with the number of non-pad tokens
            n = (ids > 0).sum(axis=1).astype(float)
            return np.stack([np.full_like(n, 5.0), n], axis=1)
        return predict

    out = K.classify_with(enc, make_predict_fn, max_length=16).collect()
    assert len(out) == 20 and all(len(r["probabilities"]) == 2 for r in out)


def test_profile_sources(spark, tmpdir_path):
    from credence.plans.profiling import LabelledSource, profile_sources, summary
    with open(f"{tmpdir_path}/fake.csv", "w") as f:
        f.write("title,text\na,b\nc,d\ne,f\n")
    with open(f"{tmpdir_path}/true.csv", "w") as f:
        f.write("title,text\ng,h\n")
    with open(f"{tmpdir_path}/fr.csv", "w") as f:
        f.write("post;label\nx;FAKE\ny;REAL\nz;REAL\n")
    with open(f"{tmpdir_path}/nolabel.csv", "w") as f:
        f.write("post;fake\nq;1\n")
    sources = [
        LabelledSource("fake_en", (f"{tmpdir_path}/fake.csv",), implied_label="FAKE"),
        LabelledSource("true_en", (f"{tmpdir_path}/missing.csv", f"{tmpdir_path}/true.csv"),
                       implied_label="REAL"),
        LabelledSource("train_fr", (f"{tmpdir_path}/fr.csv",), sep=";"),
        LabelledSource("test_fr", (f"{tmpdir_path}/absent.csv",), sep=";"),       # optional, missing
        LabelledSource("other_fr", (f"{tmpdir_path}/nolabel.csv",), sep=";"),     # no label column
    ]
    r = {(x["dataset"], x["is_total"]): x for x in profile_sources(spark, sources).collect()}
    assert (r[("fake_en", 0)]["fake"], r[("fake_en", 0)]["true"]) == (3, 0)
    assert (r[("true_en", 0)]["fake"], r[("true_en", 0)]["true"]) == (0, 1)
    assert (r[("train_fr", 0)]["fake"], r[("train_fr", 0)]["true"]) == (1, 2)
    assert r[("other_fr", 0)]["articles"] == 1 and r[("other_fr", 0)]["fake"] is None
    assert ("test_fr", 0) not in r
    tot = r[(None, 1)]
    assert (tot["articles"], tot["fake"], tot["true"]) == (8, 4, 3)
    s = summary(profile_sources(spark, sources)).collect()[0]
    assert s["fake_pct"] == 50.0 and s["true_pct"] == 37.5
