"""Named queries for the fitted models and for the sources and sinks.

k-means rounds and the steps of the text classifier are written out in their
oracles.  A forest cannot be replayed in SQL; its queries return what must hold
of every tree and of every article's score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions.text import synth_title
from credence.operators import classify as K
from credence.operators import encode as ENC
from credence.operators import epochs as E
from credence.operators import forest as R
from credence.operators import sampling as M
from credence.operators import tfidf as X
from credence.plans import sql as S
from credence.plans.catalog import ENCODE_LEN, ENCODE_SQL, SCORES_SELECT, SCORES_SQL, encoded_corpus, r6, register, rounded_scores
from credence.plans.detector import KMEANS_MAX_ITER, KMEANS_TOL, SCORE_COLUMNS, ClusterDetector
from credence.session import scratch_folder
from credence.sources.csv import read_articles, read_checked, read_first_available
from credence.sources.examples import PLAIN, SENSATIONAL, example_articles
from credence.sources.tables import CORPUS_SQL, corpus, table
from credence.streaming import scoring as ST


def _labelled(spark, sf_dir):
    return corpus(spark, sf_dir, by_doc=True).withColumn("label_id", F.col("is_fake").cast("int"))


# Rounds of the scoring k-means queries: SQL replays exactly these.  ``kmeans_fit`` goes on until the centroids settle, and so does its SQL.
ROUNDS = 4
_KMEANS = "WITH " + ",".join(part.strip() for part in (S.detector_ctes(), S.moment_ctes(), S.kmeans_ctes(ROUNDS), S.score_ctes())) + "\n"


@register("detector_end_to_end", _KMEANS + SCORES_SELECT)
def q_detector_end_to_end(spark, sf_dir):
    _, scores = ClusterDetector.fit(corpus(spark, sf_dir, by_doc=True), max_iter=ROUNDS)
    return rounded_scores(scores)


_SETTLED = "WITH RECURSIVE " + ",".join(part.strip() for part in (
    S.detector_ctes(), S.moment_ctes(), S.settled_kmeans_ctes(KMEANS_MAX_ITER, KMEANS_TOL), S.score_ctes())) + "\n"


@register("kmeans_fit", _SETTLED + """
SELECT cluster, size, round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max, round(fake_ratio, 6) AS fake_ratio FROM cstats
""")
def q_kmeans_fit(spark, sf_dir):
    model, _ = ClusterDetector.fit(corpus(spark, sf_dir, by_doc=True))
    return model.stats_df(spark).select("cluster", "size", *[r6(c).alias(c) for c in ("mean", "std", "max", "fake_ratio")])


@register("forest_fit", f"""
SELECT CAST(unnest(range(0, {R.TREES})) AS INTEGER) AS tree, n - CAST(ceil(0.1::DOUBLE * n) AS BIGINT) AS n_rows, 1 AS roots, 1 AS leaves_beyond_splits,
       0 AS uneven_splits, 0 AS bad_leaves
FROM (SELECT count(*) AS n FROM corpus)
""".replace("FROM corpus", f"FROM ({CORPUS_SQL})"))
def q_forest_fit(spark, sf_dir):
    """What must hold of the node table of every tree: rows in its leaves, one root, binary splits that part their rows, shares within 0 .. 1."""
    train, _ = M.split_exact(_labelled(spark, sf_dir))
    return forest_checks(K.fit_forest(train).nodes(spark))


def forest_checks(nodes):
    """One row a tree: rows in its leaves, roots, leaves less splits, splits whose sides do not add up, leaves with an impossible share."""
    split, leaf = F.col("feature") >= 0, F.col("feature") < 0
    sides = nodes.where(split).select("tree", "node", "n", "p_fake", "depth", F.explode(F.array("left", "right")).alias("child"))
    kids = nodes.select("tree", F.col("node").alias("child"), F.col("n").alias("m"), F.col("p_fake").alias("q"), F.col("depth").alias("below"))
    added = (sides.join(kids, ["tree", "child"], "left").groupBy("tree", "node")
             .agg(((F.count("m") != 2) | (F.sum("m") != F.first("n")) | (F.abs(F.sum(F.col("m") * F.col("q")) - F.first(F.col("n") * F.col("p_fake"))) > 1e-6)
                   | (F.min("below") != F.first("depth") + 1) | (F.max("below") != F.first("depth") + 1)).alias("uneven"))
             .groupBy("tree").agg(F.count_if("uneven").alias("uneven_splits")))
    whole = nodes.groupBy("tree").agg(F.sum(F.when(leaf, F.col("n")).otherwise(0)).alias("n_rows"), F.count_if((F.col("node") == 0) & (F.col("depth") == 0)).cast("int").alias("roots"),
                                      (F.count_if(leaf) - F.count_if(split)).cast("int").alias("leaves_beyond_splits"),
                                      F.count_if(leaf & ~F.col("p_fake").between(0, 1)).cast("int").alias("bad_leaves"))
    return whole.join(added, "tree", "left").select("tree", "n_rows", "roots", "leaves_beyond_splits", F.coalesce("uneven_splits", F.lit(0)).cast("int").alias("uneven_splits"), "bad_leaves")


@register("forest_scores", f"""
SELECT doc_id, TRUE AS share_of_votes, TRUE AS larger_class, TRUE AS texts_agree, TRUE AS loaded_agrees FROM ({CORPUS_SQL})
""")
def q_forest_scores(spark, sf_dir):
    """Scores of every article by the fitted forest and by the saved and loaded one, and whether they keep their rules."""
    data = _labelled(spark, sf_dir)
    forest = K.fit_forest(M.split_exact(data)[0])
    path = scratch_folder(spark, "forest")
    forest.save(path, spark)
    again = K.Forest.load(spark, path).classify(data).select("doc_id", F.col("p_fake").alias("p_again"))
    p = F.col("p_fake")
    return forest.classify(data).join(again, "doc_id").select(
        "doc_id", (p.between(0, 1) & (F.abs(F.col("probabilities")[0] + F.col("probabilities")[1] - 1) < 1e-12)).alias("share_of_votes"),
        ((F.col("prediction") == (p > 0.5).cast("int")) & (F.col("class_confidence") == F.greatest(p, 1 - p))).alias("larger_class"),
        ((F.col("verdict") == F.when(p > 0.5, L.VERDICT_FAKE).otherwise(L.VERDICT_TRUE)) & F.col("confidence_text").rlike("^[0-9]{2,3}[.][0-9]%$")).alias("texts_agree"),
        (F.abs(p - F.col("p_again")) < 1e-12).alias("loaded_agrees"))


_EPOCHS = "WITH " + S.epoch_ctes(f"SELECT doc_id, text, CASE WHEN is_fake THEN 1 ELSE 0 END AS label FROM ({CORPUS_SQL})", 2, E.EPOCHS, E.STEPS, E.RATE, E.BUCKETS) + "\n"
_HISTORY = """
SELECT CAST(epoch AS INTEGER) AS epoch, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(log_loss, 6) AS log_loss, round(train_loss, 6) AS train_loss, epoch = (SELECT epoch FROM best) AS best
FROM history
"""
_BEST_SCORES = """
SELECT doc_id, prediction, round(p1, 6) AS p_fake, round(top_p, 6) AS class_confidence FROM scored WHERE epoch = (SELECT epoch FROM best)
"""


def _classified(df):
    return df.select("doc_id", "prediction", r6("p_fake").alias("p_fake"), r6("class_confidence").alias("class_confidence"))


@register("text_classifier_eval", _EPOCHS + _HISTORY)
def q_text_classifier_eval(spark, sf_dir):
    """Training history; the oracle writes out every step."""
    _, history = E.fit_epochs(_labelled(spark, sf_dir))
    return history.select("epoch", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "log_loss", "train_loss")], "best")


@register("text_classifier_scores", _EPOCHS + _BEST_SCORES)
def q_text_classifier_scores(spark, sf_dir):
    data = _labelled(spark, sf_dir)
    return _classified(E.fit_epochs(data)[0].classify(data))


@register("classifier_saved_scores", _EPOCHS + _BEST_SCORES)
def q_classifier_saved_scores(spark, sf_dir):
    """Fitted, saved, loaded again: the loaded classifier gives the same scores."""
    data = _labelled(spark, sf_dir)
    path = scratch_folder(spark, "classifier")
    E.fit_epochs(data)[0].save(path, spark)
    return _classified(E.SoftmaxClassifier.load(spark, path).classify(data))


LANGS = ("de", "en", "es", "fr")
_LANG_EPOCHS = "WITH " + S.epoch_ctes(
    f"SELECT doc_id, text, list_position({list(LANGS)}, lang) - 1 AS label FROM documents WHERE lang IN {LANGS}", len(LANGS), 2, 2, E.RATE, 1 << 12) + "\n"


@register("language_classifier_scores", _LANG_EPOCHS + f"""
SELECT doc_id, prediction, {", ".join(f"round(p{j}, 6) AS p_{name}" for j, name in enumerate(LANGS))} FROM scored WHERE epoch = (SELECT epoch FROM best)
""")
def q_language_classifier_scores(spark, sf_dir):
    """Four labels: the language of every document from its words, two epochs of two steps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1).alias("label_id"))
    docs = docs.where(F.col("label_id").between(0, len(LANGS) - 1))
    clf, _ = E.fit_epochs(docs, num_labels=len(LANGS), epochs=2, steps=2, buckets=1 << 12)
    return clf.classify(docs).select("doc_id", "prediction", *[r6(F.col("probabilities")[j]).alias(f"p_{name}") for j, name in enumerate(LANGS)])


@register("stream_scores", "WITH " + ",".join(part.strip() for part in (S.detector_ctes(), S.moment_ctes(), S.kmeans_ctes(ROUNDS), S.score_ctes(), S.unseen_ctes(f"cent{ROUNDS}"))) + """
SELECT doc_id, cluster, CASE WHEN isnan(fake_score) THEN FALSE ELSE coalesce(fake_score > 0.5, FALSE) END AS predicted_fake,
       round(abs(fake_score - 0.5) * 2, 6) AS margin_confidence, round(z_score, 6) AS z_score, round(fake_score, 6) AS fake_score, round(cluster_fake_ratio, 6) AS cluster_fake_ratio
FROM new_scores
""")
def q_stream_scores(spark, sf_dir):
    """Fit k-means on the labelled corpus, then score the ``documents`` file as a stream."""
    model, _ = ClusterDetector.fit(corpus(spark, sf_dir, by_doc=True), max_iter=ROUNDS)
    schema = table(spark, sf_dir, "documents").schema
    stream = ST.article_stream(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", schema)
    stream = stream.withColumn("title", synth_title("text"))
    base = scratch_folder(spark, "stream")
    ST.score_stream_to_table(model, stream, f"{base}/out", f"{base}/ckpt")
    return rounded_scores(spark.read.parquet(f"{base}/out").select(*SCORE_COLUMNS))


@register("detector_saved_scores", SCORES_SQL)
def q_detector_saved_scores(spark, sf_dir):
    """Fitted, saved, loaded again; the loaded detector scores the corpus in long form."""
    articles = corpus(spark, sf_dir, by_doc=True)
    path = scratch_folder(spark, "detector")
    ClusterDetector.fit(articles, class_means=True)[0].save(path, spark)
    return rounded_scores(ClusterDetector.load(spark, path).score(articles))


@register("detector_vector_scores", SCORES_SQL)
def q_detector_vector_scores(spark, sf_dir):
    """The same scores row by row, without a shuffle."""
    articles = corpus(spark, sf_dir, by_doc=True)
    model, _ = ClusterDetector.fit(articles, class_means=True)
    return rounded_scores(model.score_vectors(articles))


@register("detector_stream_scores", SCORES_SQL)
def q_detector_stream_scores(spark, sf_dir):
    """The corpus as a stream of files, scored batch by batch."""
    articles = corpus(spark, sf_dir, by_doc=True)
    model, _ = ClusterDetector.fit(articles, class_means=True)
    base = scratch_folder(spark, "stream")
    articles.select("doc_id", "title", "text").write.parquet(f"{base}/in")
    stream = ST.article_stream(spark, f"{base}/in", "doc_id bigint, title string, text string")
    ST.score_stream_to_table(model, stream, f"{base}/out", f"{base}/ckpt")
    return rounded_scores(spark.read.parquet(f"{base}/out").select(*SCORE_COLUMNS))


_CSV_ORACLE = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"


def _csv_copy(spark, sf_dir, sep: str) -> str:
    path = f"{scratch_folder(spark, 'csv')}/documents"
    (table(spark, sf_dir, "documents").select("source", "text", "n_chars", "lang", "doc_id")
     .write.option("header", True).option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _csv_digest(df):
    return df.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


@register("csv_articles", _CSV_ORACLE)
def q_csv_articles(spark, sf_dir):
    """documents written as CSV and read again, columns found by name."""
    return _csv_digest(read_articles(spark, _csv_copy(spark, sf_dir, ","), table(spark, sf_dir, "documents").schema))


@register("csv_fallback_semicolon", _CSV_ORACLE)
def q_csv_fallback_semicolon(spark, sf_dir):
    """The first location is missing, the second holds the table with semicolons."""
    path = _csv_copy(spark, sf_dir, ";")
    return _csv_digest(read_first_available(spark, [f"{path}-missing", path], schema=table(spark, sf_dir, "documents").schema, sep=";"))


_CHECKED = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _faulty_csv(spark, sf_dir) -> str:
    """documents as CSV files in which rows lack their text, have a field too many, a word for a number, no id, or an unknown language."""
    path = f"{scratch_folder(spark, 'csv')}/faulty"
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    fault = F.col("doc_id") % 10
    parts = [F.when(fault == 8, "").otherwise(F.col("doc_id").cast("string")), F.col("source"), F.when(fault == 9, "xx").otherwise(F.col("lang")),
             F.when(fault == 7, "many").otherwise(F.col("n_chars").cast("string"))]
    line = F.concat(F.concat_ws(",", *parts), F.when(fault == 3, "").otherwise(F.concat(F.lit(","), quoted)), F.when(fault == 5, ",surplus").otherwise(""))

    def with_header(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array(["doc_id,source,lang,n_chars,text"])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
    table(spark, sf_dir, "documents").select(line.alias("value")).mapInArrow(with_header, "value string").write.text(path)
    return path


@register("csv_rejected_rows", """
SELECT CASE doc_id % 10 WHEN 3 THEN 'fields' WHEN 5 THEN 'fields' WHEN 7 THEN 'type:n_chars' WHEN 8 THEN 'missing:doc_id' WHEN 9 THEN 'check:language' ELSE 'good' END AS outcome,
       CASE WHEN doc_id % 10 <> 8 THEN CAST(doc_id AS VARCHAR) END AS doc_id, CASE WHEN doc_id % 10 = 9 THEN 'xx' ELSE lang END AS lang,
       CASE WHEN doc_id % 10 = 7 THEN 'many' ELSE CAST(n_chars AS VARCHAR) END AS n_chars, CASE WHEN doc_id % 10 <> 3 THEN sha256(text) END AS text_sha256,
       doc_id % 10 IN (3, 5) AS raw_kept
FROM documents
""")
def q_csv_rejected_rows(spark, sf_dir):
    """Good and rejected rows of a CSV with planted faults, with the reasons."""
    good, rejected = read_checked(spark, _faulty_csv(spark, sf_dir), _CHECKED, required=("doc_id",), checks={"language": F.col("lang").isin(*LANGS)})
    shown = lambda df, outcome, raw: df.select(outcome.alias("outcome"), F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("n_chars").cast("string").alias("n_chars"),
                                               F.sha2("text", 256).alias("text_sha256"), raw.alias("raw_kept"))
    return shown(good, F.lit("good"), F.lit(False)).unionByName(shown(rejected, F.col("reason"), F.col("record").isNotNull()))


# ---------------------------------------------------------------------------
# One article, the example relation, a user's model, subwords

_FIRST_OF_LANG = "doc_id IN (SELECT min(doc_id) FROM corpus GROUP BY lang)"


def _first_of_lang(articles):
    """The article with the least id of each language: a handful, to be scored one at a time."""
    return articles.groupBy("lang").agg(F.min_by(F.struct("doc_id", "title", "text"), "doc_id").alias("a")).select("a.*").collect()


@register("detector_one_article", SCORES_SQL.replace("FROM scores", f"FROM scores WHERE {_FIRST_OF_LANG}"))
def q_detector_one_article(spark, sf_dir):
    """Articles given one by one have the scores that they have among all."""
    articles = corpus(spark, sf_dir, by_doc=True)
    model, _ = ClusterDetector.fit(articles, class_means=True)
    one = [(r["doc_id"], model.predict_one(spark, r["title"], r["text"])) for r in _first_of_lang(articles)]
    rows = [(d, s["cluster"], s["is_fake"], s["confidence"], s["z_score"], s["fake_score"], s["cluster_fake_ratio"]) for d, s in one]
    return rounded_scores(spark.createDataFrame(rows, "doc_id bigint, cluster int, predicted_fake boolean, margin_confidence double, z_score double, fake_score double, cluster_fake_ratio double"))


@register("classifier_one_text", _EPOCHS + f", corpus AS ({CORPUS_SQL})" + _BEST_SCORES.rstrip() + f" AND {_FIRST_OF_LANG}")
def q_classifier_one_text(spark, sf_dir):
    """Texts given one by one have the scores that they have among all."""
    data = _labelled(spark, sf_dir)
    clf, _ = E.fit_epochs(data)
    one = [(r["doc_id"], clf.predict_one(spark, r["text"])) for r in _first_of_lang(data)]
    rows = [(d, s["label"], s["probabilities"][1], s["confidence"]) for d, s in one]
    return _classified(spark.createDataFrame(rows, "doc_id bigint, prediction int, p_fake double, class_confidence double"))


@register("example_known_words", "WITH ex AS (SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', {})".format(i, t.replace("'", "''"), int(i < len(SENSATIONAL))) for i, t in enumerate(SENSATIONAL + PLAIN)) + """) v(doc_id, text, label_id)),
known AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}')) AS term FROM documents) GROUP BY term),
words AS (SELECT doc_id, label_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}'))) AS term FROM ex)
SELECT CAST(doc_id AS BIGINT) AS doc_id, label_id, count(*) AS n_words, count(df) AS n_known, CAST(coalesce(sum(df), 0) AS BIGINT) AS n_documents
FROM words LEFT JOIN known USING (term) GROUP BY doc_id, label_id
""")
def q_example_known_words(spark, sf_dir):
    """The example relation against the documents: how many of a sentence's words they know."""
    docs = X.term_frequencies(X.token_terms(table(spark, sf_dir, "documents").select("doc_id", "text")))
    words = X.term_frequencies(X.token_terms(example_articles(spark), keep=("label_id",)), keep=("label_id",))
    return (words.join(X.document_frequencies(docs).select("term", "df"), "term", "left").groupBy("doc_id", "label_id")
            .agg(F.count(F.lit(1)).alias("n_words"), F.count("df").alias("n_known"), F.coalesce(F.sum("df"), F.lit(0)).cast("bigint").alias("n_documents")))


def _length_model():
    """A fixed user model: the logits are a share of the sum of the ids and of their number."""
    def predict(ids):
        import numpy as np
        return np.stack([ids.sum(axis=1) / 100_000.0, (ids != ENC.PAD_ID).sum(axis=1) / 100.0], axis=1)
    return predict


@register("user_model_scores", ENCODE_SQL + """,
lg AS (SELECT doc_id, list_sum(s) / 100000.0::DOUBLE AS l0, len(s) / 100.0::DOUBLE AS l1 FROM seqs)
SELECT doc_id, round(l0, 6) AS l0, round(l1, 6) AS l1, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction,
       round(1 / (1 + exp(-abs(l1 - l0))), 6) AS class_confidence FROM lg
""")
def q_user_model_scores(spark, sf_dir):
    """A batch model of the user's on the fixed-length encodings."""
    scored = K.classify_with(encoded_corpus(spark, sf_dir), _length_model, batch_size=64, max_length=ENCODE_LEN)
    return scored.select("doc_id", r6(F.col("logits")[0]).alias("l0"), r6(F.col("logits")[1]).alias("l1"), "prediction", r6("class_confidence").alias("class_confidence"))


@register("subword_round_trip", """
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, TRUE AS full_length, TRUE AS mask_agrees FROM documents
""")
def q_subword_round_trip(spark, sf_dir):
    """Every whole text in windows of subwords and back; all windows have the full length and a mask of their tokens."""
    import public_tokenizers
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    windows = ENC.encode_subwords(table(spark, sf_dir, "documents"), *vocabulary, whole=True)
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    shape = windows.groupBy("doc_id").agg(F.bool_and((F.size("input_ids") == ENC.DEFAULT_MAX_LENGTH) & (F.size("attention_mask") == ENC.DEFAULT_MAX_LENGTH)).alias("full_length"),
                                          F.bool_and(ones == F.col("n_tokens")).alias("mask_agrees"))
    return ENC.decode_subwords(windows, *vocabulary).select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(shape, "doc_id")
