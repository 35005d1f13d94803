import math

from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions import text as T
from credence.operators import articles as A
from credence.operators import profile as P


def _one(spark, col, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data))
    return df.select(col.alias("x")).collect()[0]["x"]


def test_accents_split_words(spark):
    words = _one(spark, T.clean_words(F.col("t")), t="être après même où citoyens")
    assert words == ["tre", "apr", "citoyens"]


def test_only_stop_words_digits_emoji(spark):
    assert _one(spark, T.clean_words(F.col("t")), t="the of le la") == []
    assert _one(spark, T.clean_words(F.col("t")), t="123 !!") == []
    assert _one(spark, T.clean_words(F.col("t")), t="😀😀abc") == ["abc"]


def test_stop_word_filter_is_hash_set(spark):
    df = spark.createDataFrame([("the cat",)], "t string").select(T.clean_words("t").alias("w"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() or "inset" in plan


def test_bigrams_bridge_removed_words(spark):
    terms = _one(spark, T.ngrams_1_2(T.clean_words("t")), t="alpha the beta gamma")
    assert terms == ["alpha", "beta", "gamma", "alpha beta", "beta gamma"]
    assert _one(spark, T.ngrams_1_2(T.clean_words("t")), t="one") == ["one"]
    assert _one(spark, T.bigrams(T.clean_words("t")), t="single") == []


def test_synth_title_code_points(spark):
    text = "é" * 150
    assert _one(spark, T.synth_title("t"), t=text) == "é" * 100 + "..."
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.synth_title("t")).collect()[0][0] is None


def test_null_policy(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), ("t", None)], "title string, text string")
    got = [r[0] for r in df.select(T.weighted_text("title", "text")).collect()]
    assert got == ["nan nan b", "  b", "t t nan"]
    blank = [r[0] for r in df.select(T.weighted_text("title", "text", null_as="")).collect()]
    assert blank == ["  b", "  b", "t t "]
    opt = [r[0] for r in df.select(T.optional_title_text("title", "text")).collect()]
    assert opt == ["b", "b", "t"]  # concat_ws drops the NULL text


def test_unicode_tokens(spark):
    toks = _one(spark, T.unicode_tokens("t"), t="Déjà vu: a_b x 42 Ünïcode")
    assert toks == ["déjà", "vu", "a_b", "42", "ünïcode"]


def test_scorable_and_labels(spark):
    df = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, "x")], "doc_id int, text string")
    assert sorted(r[0] for r in A.scorable(df).collect()) == [2, 4]
    lab = spark.createDataFrame([("FAKE",), ("REAL",), (None,)], "label string")
    assert [r[0] for r in lab.select(L.encode_label("label")).collect()] == [1, 0, None]
    num = spark.createDataFrame([(0.0,), (2.0,), (None,)], "fake double")
    assert [r[0] for r in num.select(L.to_is_fake("fake")).collect()] == [False, True, None]
    assert [r[0] for r in num.select(L.to_is_fake("fake", True)).collect()] == [False, True, True]


def test_rollup_totals_and_percentages(spark):
    rows = [(i, "a" if i < 6 else "b", "FAKE" if i % 3 == 0 else "REAL") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id int, dataset string, label string")
    r = {(x["dataset"], x["is_total"]): x for x in P.dataset_rollup(df).collect()}
    total = r[(None, 1)]
    assert total["articles"] == 10 and total["fake"] == 4 and total["true"] == 6
    assert r[("a", 0)]["articles"] + r[("b", 0)]["articles"] == total["articles"]
    pct = P.label_percentages(df).collect()[0]
    assert pct["fake_pct"] == 40.0 and pct["true_pct"] == 60.0
    empty = spark.createDataFrame([], "doc_id int, dataset string, label string")
    assert P.label_percentages(empty).collect()[0]["fake_pct"] is None


def test_implied_label_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "fake_en", None), (2, "true_en", None), (3, "fr", "FAKE"),
                                (4, "de", None)], "doc_id int, dataset string, label string")
    out = {r["dataset"]: r for r in
           P.dataset_stats(P.implied_label(df, {"fake_en": "FAKE", "true_en": "REAL"})).collect()}
    assert (out["fake_en"]["fake"], out["fake_en"]["true"]) == (1, 0)
    assert (out["true_en"]["fake"], out["true_en"]["true"]) == (0, 1)
    assert out["fr"]["fake"] == 1
    assert out["de"]["articles"] == 1 and out["de"]["fake"] is None


def test_harmonise_by_name(spark):
    fake = spark.createDataFrame([("t1", "x")], "title string, text string")
    true = spark.createDataFrame([("t2", "y")], "title string, text string")
    fr = spark.createDataFrame([("z" * 120, "m", 1.0), ("w", "m", 0.0)],
                               "post string, media string, fake double")
    out = A.harmonise_articles(A.harmonise_english(fake, true), A.harmonise_french(fr))
    rows = {r["text"]: r for r in out.collect()}
    assert out.columns == list(A.ARTICLE_COLUMNS)
    assert rows["x"]["is_fake"] is True and rows["y"]["is_fake"] is False
    assert rows["x"]["source"] is None and rows["w"]["source"] == "m"
    assert rows["z" * 120]["title"] == "z" * 100 + "..." and rows["w"]["is_fake"] is False


def test_score_boundary(spark):
    df = spark.createDataFrame([(0.5,), (0.75,), (float("nan"),)], "s double")
    got = df.select(L.decide("s"), L.margin_confidence("s")).collect()
    assert got[0][0] is False and got[0][1] == 0.0
    assert got[1][0] is True and math.isclose(got[1][1], 0.5)
    assert got[2][0] is False


def test_zscore_zero_std(spark):
    df = spark.createDataFrame([(2.0, 1.0, 0.0), (0.5, 1.0, 0.0), (1.0, 1.0, 0.0), (3.0, 1.0, 2.0)],
                               "d double, m double, s double")
    z = [r[0] for r in df.select(L.zscore("d", "m", "s")).collect()]
    assert z[0] == float("inf") and z[1] == float("-inf") and math.isnan(z[2]) and z[3] == 1.0
    pen = [r[0] for r in df.select(L.logistic_penalty(L.zscore("d", "m", "s"))).collect()]
    assert pen[0] == 1.0 and pen[1] == 0.0 and math.isnan(pen[2])
