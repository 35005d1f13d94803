"""Registry of named queries over the test tables, each with its DuckDB oracle.

Every query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
given parquet tables (or data Spark derives from them) and runs on all rows.
Computed columns carry the same aliases as the oracle SQL; doubles are
rounded to 6 digits on both sides so that summation order cannot change the
compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import labels as L
from credence.functions import text as T
from credence.operators import articles as A
from credence.operators import clusters as C
from credence.operators import encode as E
from credence.operators import evaluate as V
from credence.operators import profile as P
from credence.operators import sampling as M
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.plans import sql as S
from credence.session import materialize
from credence.sources.tables import CORPUS_SQL, corpus, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


WITH_CORPUS = f"WITH corpus AS ({CORPUS_SQL})\n"

# ---------------------------------------------------------------------------
# Harmonising sources


def _en_files(c: DataFrame):
    en = c.filter(F.col("lang") == "en").select("doc_id", "title", "text", "is_fake")
    return (en.filter(F.col("is_fake")).drop("is_fake"),
            en.filter(~F.col("is_fake")).drop("is_fake"))


def _fr_file(c: DataFrame) -> DataFrame:
    """The rows of all other languages in the French file's form."""
    return c.filter(F.col("lang") != "en").select(
        "doc_id", F.col("text").alias("post"), F.col("source").alias("media"),
        F.col("is_fake").cast("int").alias("fake"))


@register("harmonise_articles", WITH_CORPUS + """
SELECT doc_id, title, text, 'en' AS lang, CAST(NULL AS VARCHAR) AS source, TRUE AS is_fake
FROM corpus WHERE lang = 'en' AND is_fake
UNION ALL
SELECT doc_id, title, text, 'en', NULL, FALSE FROM corpus WHERE lang = 'en' AND NOT is_fake
UNION ALL
SELECT doc_id, substring(text, 1, 100) || '...', text, 'fr', source, (CAST(is_fake AS INTEGER) <> 0)
FROM corpus WHERE lang <> 'en'
""")
def q_harmonise_articles(spark, sf_dir):
    c = corpus(spark, sf_dir)
    fake, true = _en_files(c)
    return A.harmonise_articles(A.harmonise_english(fake, true), A.harmonise_french(_fr_file(c)))


@register("union_label_files", WITH_CORPUS + """
SELECT doc_id, TRUE AS is_fake, 'en' AS lang FROM corpus WHERE is_fake
UNION ALL
SELECT doc_id, FALSE, 'en' FROM corpus WHERE NOT is_fake
""")
def q_union_label_files(spark, sf_dir):
    """Every row plays one of the two one-class files, whatever its language."""
    c = corpus(spark, sf_dir).select("doc_id", "is_fake")
    fake, true = c.filter("is_fake").drop("is_fake"), c.filter("not is_fake").drop("is_fake")
    return A.harmonise_english(fake, true).select("doc_id", "is_fake", "lang")


@register("union_by_name", WITH_CORPUS + """
SELECT doc_id, title, text, CAST(NULL AS VARCHAR) AS source FROM corpus WHERE lang = 'en'
UNION ALL
SELECT doc_id, NULL, text, source FROM corpus WHERE lang <> 'en'
""")
def q_union_by_name(spark, sf_dir):
    c = corpus(spark, sf_dir)
    en = c.filter(F.col("lang") == "en").select("doc_id", "title", "text")
    fr = c.filter(F.col("lang") != "en").select("doc_id", "text", "source")
    return A.union_articles(en, fr, allow_missing=True).select("doc_id", "title", "text", "source")


@register("synth_title", """
SELECT doc_id, substring(text, 1, 100) || '...' AS title FROM documents
""")
def q_synth_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.synth_title("text").alias("title"))


@register("weighted_text", WITH_CORPUS + f"""
SELECT doc_id, {S.weighted_sql()} AS document FROM corpus
""")
def q_weighted_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.weighted_text("title", "text").alias("document"))


@register("optional_title_text", WITH_CORPUS + """
SELECT doc_id, CASE WHEN t IS NOT NULL AND length(t) > 0 THEN t || ' ' || text ELSE text END AS document
FROM (SELECT doc_id, text, CASE WHEN lang IN ('en', 'fr') THEN title ELSE '' END AS t FROM corpus)
""")
def q_optional_title_text(spark, sf_dir):
    c = corpus(spark, sf_dir)
    t = F.when(F.col("lang").isin("en", "fr"), F.col("title")).otherwise(F.lit(""))
    return c.select("doc_id", T.optional_title_text(t, "text").alias("document"))


@register("null_text_policy", WITH_CORPUS + f"""
SELECT d.doc_id, {S.weighted_sql('c.title', 'd.text')} AS document,
       coalesce(c.title, '') || ' ' || coalesce(c.title, '') || ' ' || coalesce(d.text, '') AS document_blank
FROM documents d LEFT JOIN corpus c ON d.doc_id = c.doc_id
""")
def q_null_text_policy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    titles = corpus(spark, sf_dir).select("doc_id", "title")
    j = docs.join(titles, "doc_id", "left")
    return j.select("doc_id", T.weighted_text("title", "text").alias("document"),
                    T.weighted_text("title", "text", null_as="").alias("document_blank"))


@register("scorable_articles", """
SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND length(text) > 0
""")
def q_scorable_articles(spark, sf_dir):
    return A.scorable(table(spark, sf_dir, "documents")).select("doc_id", "lang")


@register("label_filter", WITH_CORPUS + """
SELECT doc_id, lang FROM corpus WHERE label = 'FAKE'
""")
def q_label_filter(spark, sf_dir):
    return A.label_is(corpus(spark, sf_dir), L.FAKE_LABEL).select("doc_id", "lang")


@register("encode_label", WITH_CORPUS + """
SELECT doc_id, label, CASE WHEN label IS NULL THEN NULL WHEN label = 'FAKE' THEN 1 ELSE 0 END AS y
FROM corpus
""")
def q_encode_label(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "label", L.encode_label("label").alias("y"))


# ---------------------------------------------------------------------------
# Profiling

_LABEL_AGGS = """CAST(count(*) AS BIGINT) AS articles,
       CASE WHEN count(label) > 0 THEN CAST(count_if(label = 'FAKE') AS BIGINT) END AS fake,
       CASE WHEN count(label) > 0 THEN CAST(count_if(label = 'REAL') AS BIGINT) END AS "true\""""


@register("count_by_lang", """
SELECT lang, CAST(count(*) AS BIGINT) AS articles FROM documents GROUP BY lang
""")
def q_count_by_lang(spark, sf_dir):
    return P.count_by(table(spark, sf_dir, "documents"), "lang")


@register("label_counts", WITH_CORPUS + f"SELECT {_LABEL_AGGS} FROM corpus")
def q_label_counts(spark, sf_dir):
    return P.label_counts(corpus(spark, sf_dir))


@register("dataset_stats", WITH_CORPUS + f"SELECT dataset, {_LABEL_AGGS} FROM corpus GROUP BY dataset")
def q_dataset_stats(spark, sf_dir):
    return P.dataset_stats(corpus(spark, sf_dir))


@register("dataset_rollup", WITH_CORPUS + f"""
SELECT dataset, CAST(grouping(dataset) AS INTEGER) AS is_total, {_LABEL_AGGS}
FROM corpus GROUP BY ROLLUP (dataset)
""")
def q_dataset_rollup(spark, sf_dir):
    return P.dataset_rollup(corpus(spark, sf_dir))


@register("label_percentages", WITH_CORPUS + f"""
SELECT articles, fake, "true",
       CASE WHEN articles > 0 THEN round(100.0::DOUBLE * fake / articles, 1) END AS fake_pct,
       CASE WHEN articles > 0 THEN round(100.0::DOUBLE * "true" / articles, 1) END AS true_pct
FROM (SELECT {_LABEL_AGGS} FROM corpus)
""")
def q_label_percentages(spark, sf_dir):
    return P.label_percentages(corpus(spark, sf_dir))


_IMPLIED = {"fake_en": L.FAKE_LABEL, "true_en": L.REAL_LABEL}


def _implied_input(c: DataFrame) -> DataFrame:
    """One-class English files (no label column), the labelled French file and
    rows of the other languages that carry no label information at all."""
    name = (F.when((F.col("lang") == "en") & F.col("is_fake"), F.lit("fake_en"))
            .when(F.col("lang") == "en", F.lit("true_en"))
            .when(F.col("lang") == "fr", F.lit("train_fr"))
            .otherwise(F.concat(F.lit("unlabelled_"), F.col("lang"))))
    lab = F.when(F.col("lang") == "fr", F.col("label"))
    return c.select("doc_id", name.alias("dataset"), lab.alias("label"))


@register("implied_label_stats", WITH_CORPUS + f"""
SELECT dataset, {_LABEL_AGGS}
FROM (SELECT doc_id, dataset,
             CASE dataset WHEN 'fake_en' THEN 'FAKE' WHEN 'true_en' THEN 'REAL' ELSE label END AS label
      FROM (SELECT doc_id,
                   CASE WHEN lang = 'en' AND is_fake THEN 'fake_en' WHEN lang = 'en' THEN 'true_en'
                        WHEN lang = 'fr' THEN 'train_fr' ELSE 'unlabelled_' || lang END AS dataset,
                   CASE WHEN lang = 'fr' THEN label END AS label
            FROM corpus))
GROUP BY dataset
""")
def q_implied_label_stats(spark, sf_dir):
    src = _implied_input(corpus(spark, sf_dir))
    return P.dataset_stats(P.implied_label(src, _IMPLIED))


@register("labelled_stats_record", WITH_CORPUS + """, named AS (
  SELECT CASE WHEN lang IN ('en', 'fr') THEN label END AS label, lang AS dataset FROM corpus),
stats AS (SELECT dataset, count(*) AS articles, count_if(label = 'FAKE') AS fake, count_if(label = 'REAL') AS real
          FROM named GROUP BY dataset HAVING count(label) > 0)
SELECT CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(fake) AS BIGINT) AS fake, CAST(sum(real) AS BIGINT) AS "true",
       round(100.0::DOUBLE * sum(fake) / sum(articles), 1) AS fake_pct, round(100.0::DOUBLE * sum(real) / sum(articles), 1) AS true_pct,
       string_agg(dataset || ':' || articles || ':' || fake || ':' || real, '|' ORDER BY dataset) AS datasets
FROM stats
""")
def q_labelled_stats_record(spark, sf_dir):
    """Labels of English and French rows only: the other datasets are unlabelled and left out of the totals."""
    c = corpus(spark, sf_dir).select("dataset", F.when(F.col("lang").isin("en", "fr"), F.col("label")).alias("label"))
    text = F.transform("datasets", lambda d: F.concat_ws(":", d["name"], d["articles"], d["fake"], d["true"]))
    return P.stats_record(c, skip_unlabelled=True).withColumn("datasets", F.array_join(text, "|"))


_TYPE_MAP_SQL = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
       WHEN 'BOOLEAN' THEN 'boolean' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       ELSE lower(column_type) END"""


_PROFILE_COLS = ("doc_id", "title", "text", "lang", "source", "is_fake")


@register("schema_profile", f"""
WITH corpus AS ({CORPUS_SQL}),
schema AS (
  SELECT column_name, {_TYPE_MAP_SQL} AS data_type,
         CAST(row_number() OVER () - 1 AS INTEGER) AS position
  FROM (DESCRIBE SELECT {", ".join(_PROFILE_COLS)} FROM corpus)),
counts AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS non_null FROM corpus"
                      for c in _PROFILE_COLS)})
SELECT s.column_name, s.data_type, s.position, c.non_null
FROM schema s JOIN counts c ON s.column_name = c.column_name
""")
def q_schema_profile(spark, sf_dir):
    c = corpus(spark, sf_dir).select(*_PROFILE_COLS)
    return P.column_profile(c)


# ---------------------------------------------------------------------------
# Text (T1-T6)


@register("strip_non_letters", """
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS cleaned FROM documents
""")
def q_strip_non_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_non_letters("text").alias("cleaned"))


@register("token_counts", """
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]+')) AS INTEGER) AS n_words FROM documents
""")
def q_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.letter_words("text")).cast("int").alias("n_words"))


@register("clean_text", WITH_CORPUS + f"""
SELECT doc_id, array_to_string({S.words_sql(S.weighted_sql())}, ' ') AS clean FROM corpus
""")
def q_clean_text(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", T.join_words(T.clean_words(T.weighted_text("title", "text"))).alias("clean"))


@register("unicode_tokens", """
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}') AS tok FROM documents)
""")
def q_unicode_tokens(spark, sf_dir):
    tok = T.unicode_tokens("text")
    return (table(spark, sf_dir, "documents").select("doc_id", tok.alias("tok"))
            .select("doc_id", F.size("tok").cast("int").alias("n_tokens"),
                    F.array_join("tok", " ").alias("tokens")))


@register("bigram_counts", WITH_CORPUS + f"""
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_unigrams,
       CAST(greatest(len(w) - 1, 0) AS INTEGER) AS n_bigrams,
       CAST(len({S.ngrams_sql()}) AS INTEGER) AS n_terms,
       coalesce(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|'), '') AS bigrams
FROM (SELECT doc_id, {S.words_sql(S.weighted_sql())} AS w FROM corpus)
""")
def q_bigram_counts(spark, sf_dir):
    w = T.clean_words(T.weighted_text("title", "text"))
    return (corpus(spark, sf_dir).select("doc_id", w.alias("w"))
            .select("doc_id", F.size("w").cast("int").alias("n_unigrams"),
                    F.size(T.bigrams(F.col("w"))).cast("int").alias("n_bigrams"),
                    F.size(T.ngrams_1_2(F.col("w"))).cast("int").alias("n_terms"),
                    F.array_join(T.bigrams(F.col("w")), "|").alias("bigrams")))


# ---------------------------------------------------------------------------
# TF-IDF long form


def _detector_tf(spark, sf_dir, fit_langs=None):
    """Corpus, its term counts, those of the rows to fit on and the number of these rows."""
    c = corpus(spark, sf_dir, by_doc=True)
    tf = X.term_frequencies(X.detector_terms(c, keep=("is_fake", "lang")), keep=("is_fake", "lang"))
    fit = c if fit_langs is None else c.filter(F.col("lang").isin(*fit_langs))
    fit_tf = tf if fit_langs is None else tf.filter(F.col("lang").isin(*fit_langs))
    return c, tf, fit_tf, fit.count()


def _fitted(spark, sf_dir, fit_langs=None):
    c, tf, fit_tf, n = _detector_tf(spark, sf_dir, fit_langs)
    vocab = X.fit_vocabulary(fit_tf, n, X.DETECTOR_MAX_FEATURES, X.DETECTOR_MIN_DF)
    # Sparse rows are small and written once; the uni+bigram table is never kept.
    sparse = materialize(VF.sparse_counts(X.detector_terms(c, keep=("is_fake",)), vocab))
    return c, vocab, VF.long_weights(sparse, vocab, ("is_fake",)), n


@register("term_freq", "WITH " + S.detector_ctes().strip() + """
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf
""")
def q_term_freq(spark, sf_dir):
    _, tf, _, _ = _detector_tf(spark, sf_dir)
    return tf.select("doc_id", "term", "tf")


@register("doc_freq", "WITH " + S.detector_ctes().strip() + """
SELECT term, df, n FROM dfreq
""")
def q_doc_freq(spark, sf_dir):
    _, tf, _, _ = _detector_tf(spark, sf_dir)
    return X.document_frequencies(tf, X.DETECTOR_MIN_DF)


@register("vocabulary_topk", "WITH " + S.detector_ctes().strip() + """
SELECT term_id, term, df, n, round(idf, 6) AS idf FROM vocab
""")
def q_vocabulary_topk(spark, sf_dir):
    _, _, fit_tf, n = _detector_tf(spark, sf_dir)
    v = X.fit_vocabulary(fit_tf, n, X.DETECTOR_MAX_FEATURES, X.DETECTOR_MIN_DF).to_df(spark)
    return v.select("term_id", "term", "df", "n", r6("idf").alias("idf"))


@register("smooth_idf", "WITH " + S.detector_ctes().strip() + """
SELECT term, round(idf, 6) AS idf FROM vocab
""")
def q_smooth_idf(spark, sf_dir):
    _, _, fit_tf, n = _detector_tf(spark, sf_dir)
    vocab = X.fit_vocabulary(fit_tf, n, X.DETECTOR_MAX_FEATURES, X.DETECTOR_MIN_DF)
    return vocab.to_df(spark).select("term", r6("idf").alias("idf"))


@register("tfidf_weights", "WITH " + S.detector_ctes().strip() + """
SELECT doc_id, term_id, round(weight, 6) AS weight FROM weights
""")
def q_tfidf_weights(spark, sf_dir):
    _, _, weights, _ = _fitted(spark, sf_dir)
    return weights.select("doc_id", "term_id", r6("weight").alias("weight"))


@register("transform_unseen", "WITH " + S.detector_ctes(fit_filter="lang IN ('en', 'fr')").strip() + """
SELECT doc_id, term_id, round(weight, 6) AS weight FROM weights WHERE lang NOT IN ('en', 'fr')
""")
def q_transform_unseen(spark, sf_dir):
    c, tf, fit_tf, n = _detector_tf(spark, sf_dir, fit_langs=("en", "fr"))
    vocab = X.fit_vocabulary(fit_tf, n, X.DETECTOR_MAX_FEATURES, X.DETECTOR_MIN_DF)
    unseen = tf.filter(~F.col("lang").isin("en", "fr"))
    w = X.tfidf_weights(unseen, vocab.to_df(spark))
    return w.select("doc_id", "term_id", r6("weight").alias("weight"))


@register("feature_moments", "WITH " + S.detector_ctes().strip() + "," + S.scoring_ctes().strip() + """
SELECT term_id, round(mean, 6) AS mean, round(std, 6) AS std, round(scale, 6) AS scale FROM moments
""")
def q_feature_moments(spark, sf_dir):
    _, _, weights, n = _fitted(spark, sf_dir)
    m = X.feature_moments(weights, n)
    return m.select("term_id", *[r6(c).alias(c) for c in ("mean", "std", "scale")])


# ---------------------------------------------------------------------------
# Clusters with class-mean centroids


def _class_mean_chain(spark, sf_dir):
    c, vocab, weights, n = _fitted(spark, sf_dir)
    scaler = X.fit_scaler(weights, n, len(vocab))
    scaled = X.scaled_weights(weights, scaler.to_df(spark))
    docs = c.select("doc_id", "is_fake")
    cent = C.fit_class_mean_centroids(scaled, docs, len(vocab))
    d2 = C.squared_distances(scaled, docs, cent, keep=("is_fake",))
    return c, scaled, docs, materialize(C.assign_nearest(d2))


_SCORING = "WITH " + S.detector_ctes().strip() + "," + S.scoring_ctes().strip() + "\n"


@register("feature_moments_constant", """
WITH w AS (SELECT 0 AS term_id, 0.57735::DOUBLE AS weight FROM documents
           UNION ALL SELECT 1, n_chars / 1000.0::DOUBLE FROM documents WHERE n_chars % 2 = 0),
n AS (SELECT count(*) AS n FROM documents),
m AS (SELECT term_id, sum(weight) / any_value(n) AS mean, any_value(n) - count(*) AS zeros, any_value(n) AS n FROM w, n GROUP BY term_id)
SELECT w.term_id, round(any_value(m.mean), 6) AS mean,
       round(CASE WHEN w.term_id = 0 THEN 0 ELSE sqrt((sum(pow(weight - mean, 2)) + any_value(zeros * mean * mean)) / any_value(n)) END, 6) AS std,
       round(CASE WHEN w.term_id = 0 THEN 1 ELSE sqrt((sum(pow(weight - mean, 2)) + any_value(zeros * mean * mean)) / any_value(n)) END, 6) AS scale
FROM w JOIN m ON w.term_id = m.term_id GROUP BY w.term_id
""")
def q_feature_moments_constant(spark, sf_dir):
    """A feature of the same weight in every document has scale 1; another one is in half of them."""
    d = table(spark, sf_dir, "documents").select("n_chars")
    weights = (d.select(F.lit(0).alias("term_id"), F.lit(0.57735).alias("weight"))
               .unionByName(d.where("n_chars % 2 = 0").select(F.lit(1).alias("term_id"), (F.col("n_chars") / F.lit(1000.0)).alias("weight"))))
    m = X.feature_moments(weights, d.count())
    return m.select("term_id", r6("mean").alias("mean"), r6("std").alias("std"), r6("scale").alias("scale"))


@register("class_centroids", _SCORING + """
SELECT cluster, term_id, round(value, 6) AS value FROM centroids
""")
def q_class_centroids(spark, sf_dir):
    c, vocab, weights, n = _fitted(spark, sf_dir)
    scaler = X.fit_scaler(weights, n, len(vocab))
    scaled = X.scaled_weights(weights, scaler.to_df(spark))
    cdf = C.class_mean_centroids_df(scaled, c.select("doc_id", "is_fake"))
    return cdf.select("cluster", "term_id", r6("value").alias("value"))


@register("assign_nearest", _SCORING + "SELECT doc_id, cluster FROM assigned")
def q_assign_nearest(spark, sf_dir):
    return _class_mean_chain(spark, sf_dir)[3].select("doc_id", "cluster")


@register("centroid_distance", _SCORING + """
SELECT doc_id, cluster, round(distance, 6) AS distance FROM assigned
""")
def q_centroid_distance(spark, sf_dir):
    a = _class_mean_chain(spark, sf_dir)[3]
    return a.select("doc_id", "cluster", r6("distance").alias("distance"))


@register("cluster_distance_stats", _SCORING + """
SELECT cluster, size, round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max FROM cstats
""")
def q_cluster_distance_stats(spark, sf_dir):
    st = C.cluster_distance_stats(_class_mean_chain(spark, sf_dir)[3])
    return st.select("cluster", "size", *[r6(x).alias(x) for x in ("mean", "std", "max")])


@register("cluster_label_ratio", _SCORING + """
SELECT cluster, round(fake_ratio, 6) AS fake_ratio FROM cstats
""")
def q_cluster_label_ratio(spark, sf_dir):
    st = C.cluster_distance_stats(_class_mean_chain(spark, sf_dir)[3])
    return st.select("cluster", r6("fake_ratio").alias("fake_ratio"))


def _scores(spark, sf_dir):
    a = _class_mean_chain(spark, sf_dir)[3]
    return C.score_assigned(a, C.cluster_distance_stats(a))


@register("distance_zscore", _SCORING + """
SELECT doc_id, cluster, round(distance, 6) AS distance, round(z_score, 6) AS z_score FROM zs
""")
def q_distance_zscore(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select("doc_id", "cluster", r6("distance").alias("distance"), r6("z_score").alias("z_score"))


SCORES_SELECT = """
SELECT doc_id, cluster,
       CASE WHEN isnan(fake_score) THEN FALSE ELSE fake_score > 0.5 END AS predicted_fake,
       round(abs(fake_score - 0.5) * 2, 6) AS margin_confidence,
       round(z_score, 6) AS z_score, round(fake_score, 6) AS fake_score,
       round(cluster_fake_ratio, 6) AS cluster_fake_ratio
FROM scores
"""
SCORES_SQL = _SCORING + SCORES_SELECT


def rounded_scores(s: DataFrame) -> DataFrame:
    return s.select("doc_id", "cluster", "predicted_fake",
                    *[r6(x).alias(x) for x in ("margin_confidence", "z_score", "fake_score",
                                               "cluster_fake_ratio")])


@register("score_articles", SCORES_SQL)
def q_score_articles(spark, sf_dir):
    return rounded_scores(_scores(spark, sf_dir))


@register("eval_accuracy", _SCORING + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(p = is_fake) AS BIGINT) AS correct,
       round(avg(CAST(p = is_fake AS DOUBLE)), 6) AS accuracy
FROM (SELECT s.doc_id, CASE WHEN isnan(s.fake_score) THEN FALSE ELSE s.fake_score > 0.5 END AS p, c.is_fake
      FROM scores s JOIN corpus c ON s.doc_id = c.doc_id)
""")
def q_eval_accuracy(spark, sf_dir):
    s = _scores(spark, sf_dir).select("doc_id", F.col("predicted_fake").alias("prediction"))
    truth = corpus(spark, sf_dir).select("doc_id", F.col("is_fake").alias("truth"))
    acc = V.accuracy(V.align(s, truth))
    return acc.select("n", "correct", r6("accuracy").alias("accuracy"))


@register("choose_k", WITH_CORPUS + """
SELECT relation, n, CAST(least(8, greatest(3, n // 1000)) AS INTEGER) AS k
FROM (SELECT 'corpus' AS relation, CAST(count(*) AS BIGINT) AS n FROM corpus
      UNION ALL SELECT 'documents', CAST(count(*) AS BIGINT) FROM documents)
""")
def q_choose_k(spark, sf_dir):
    cnt = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
    u = cnt(corpus(spark, sf_dir), "corpus").unionByName(cnt(table(spark, sf_dir, "documents"), "documents"))
    return u.select("relation", "n", C.choose_k_col(F.col("n")).alias("k"))


# ---------------------------------------------------------------------------
# Evaluation of per-epoch logits derived from ``embeddings``

EPOCHS = 3
BATCH = 8


def _epoch_predictions(spark, sf_dir) -> DataFrame:
    """Epoch e uses components (2e-1, 2e) of each embedding as logits; truth = label % 2."""
    emb = table(spark, sf_dir, "embeddings")
    e = F.col("epoch")
    logits = F.array(F.element_at("embedding", 2 * e - 1).cast("double"),
                     F.element_at("embedding", 2 * e).cast("double"))
    return (emb.select("vec_id", "embedding", (F.col("label") % 2).cast("int").alias("truth"),
                       F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
            .select("vec_id", "epoch", "truth", logits.alias("logits")))


_EPOCH_SQL = f"""WITH ex AS (
  SELECT vec_id, label, embedding, CAST(unnest(range(1, {EPOCHS + 1})) AS INTEGER) AS epoch FROM embeddings),
ep AS (
  SELECT vec_id, epoch, CAST(label % 2 AS INTEGER) AS truth,
         CAST(embedding[2 * epoch - 1] AS DOUBLE) AS l0, CAST(embedding[2 * epoch] AS DOUBLE) AS l1
  FROM ex),
sm AS (
  SELECT *, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p0,
            exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p1,
            CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction
  FROM ep),
pr AS (SELECT *, CASE WHEN prediction = 1 THEN p1 ELSE p0 END AS class_confidence FROM sm),
bm AS (
  SELECT epoch, CAST(count(*) AS BIGINT) AS n,
         CAST(count_if(prediction = 1 AND truth = 1) AS BIGINT) AS tp,
         CAST(count_if(prediction = 1 AND truth <> 1) AS BIGINT) AS fp,
         CAST(count_if(prediction <> 1 AND truth = 1) AS BIGINT) AS fn,
         CAST(count_if(prediction <> 1 AND truth <> 1) AS BIGINT) AS tn
  FROM pr GROUP BY epoch),
metrics AS (
  SELECT *, CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM bm)
"""


def _epoch_scored(spark, sf_dir):
    return V.with_softmax(_epoch_predictions(spark, sf_dir))


@register("softmax_scores", _EPOCH_SQL + """
SELECT vec_id, epoch, CAST(prediction AS INTEGER) AS prediction, round(p0, 6) AS p0, round(p1, 6) AS p1
FROM pr
""")
def q_softmax_scores(spark, sf_dir):
    s = _epoch_scored(spark, sf_dir)
    return s.select("vec_id", "epoch", "prediction",
                    r6(F.col("probabilities")[0]).alias("p0"), r6(F.col("probabilities")[1]).alias("p1"))


@register("predicted_confidence", _EPOCH_SQL + """
SELECT vec_id, epoch, CAST(prediction AS INTEGER) AS prediction,
       round(class_confidence, 6) AS class_confidence FROM pr
""")
def q_predicted_confidence(spark, sf_dir):
    s = _epoch_scored(spark, sf_dir)
    return s.select("vec_id", "epoch", "prediction", r6("class_confidence").alias("class_confidence"))


@register("verdict_text", _EPOCH_SQL + f"""
SELECT vec_id, epoch,
       CASE WHEN prediction = 1 THEN '{L.VERDICT_FAKE}' ELSE '{L.VERDICT_TRUE}' END AS verdict,
       printf('%.1f%%', class_confidence * 100.0) AS confidence_text FROM pr
""")
def q_verdict_text(spark, sf_dir):
    s = _epoch_scored(spark, sf_dir)
    return s.select("vec_id", "epoch", L.verdict("prediction").alias("verdict"),
                    L.percent_text("class_confidence").alias("confidence_text"))


@register("confusion_matrix", _EPOCH_SQL + """
SELECT epoch, truth, CAST(prediction AS INTEGER) AS prediction, CAST(count(*) AS BIGINT) AS n
FROM pr GROUP BY epoch, truth, prediction
""")
def q_confusion_matrix(spark, sf_dir):
    return V.confusion(_epoch_scored(spark, sf_dir), group="epoch")


@register("eval_binary_metrics", _EPOCH_SQL + """
SELECT epoch, n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics
""")
def q_eval_binary_metrics(spark, sf_dir):
    m = V.binary_metrics(_epoch_scored(spark, sf_dir), group="epoch")
    return m.select("epoch", "n", "tp", "fp", "fn", "tn",
                    *[r6(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@register("eval_log_loss", _EPOCH_SQL + f"""
SELECT epoch, round(avg(m), 6) AS log_loss, CAST(count(*) AS BIGINT) AS batches
FROM (SELECT epoch, b, avg(nll) AS m
      FROM (SELECT epoch, -ln(CASE WHEN truth = 1 THEN p1 ELSE p0 END) AS nll,
                   (row_number() OVER (PARTITION BY epoch ORDER BY vec_id) - 1) // {BATCH} AS b FROM pr)
      GROUP BY epoch, b)
GROUP BY epoch
""")
def q_eval_log_loss(spark, sf_dir):
    s = _epoch_scored(spark, sf_dir)
    ll = V.log_loss(s, group="epoch", batch_size=BATCH, order_col="vec_id")
    return ll.select("epoch", r6("log_loss").alias("log_loss"), F.col("batches").cast("bigint"))


@register("eval_log_loss_saturated", """
SELECT epoch, count(*) AS n, round(avg(greatest(d, 0) + ln(1 + exp(-abs(d)))), 6) AS log_loss
FROM (SELECT vec_id % 3 AS epoch,
             1000.0::DOUBLE * CASE WHEN vec_id % 2 = 1 THEN CAST(embedding[1] AS DOUBLE) - embedding[2] ELSE CAST(embedding[2] AS DOUBLE) - embedding[1] END AS d
      FROM embeddings)
GROUP BY epoch
""")
def q_eval_log_loss_saturated(spark, sf_dir):
    """Logits so far apart that most softmax probabilities are exactly 0 or 1."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double") * F.lit(1000.0))
    s = e.select((F.col("vec_id") % 3).alias("epoch"), (F.col("vec_id") % 2).alias("truth"), logits.alias("logits"))
    n = s.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
    return V.log_loss(s, group="epoch", logits="logits").join(n, "epoch").select("epoch", "n", r6("log_loss").alias("log_loss"))


@register("best_epoch", _EPOCH_SQL + """
SELECT epoch AS best_epoch, round(accuracy, 6) AS best_accuracy
FROM metrics ORDER BY accuracy DESC, epoch LIMIT 1
""")
def q_best_epoch(spark, sf_dir):
    m = V.binary_metrics(_epoch_scored(spark, sf_dir), group="epoch")
    b = V.best_epoch(m)
    return b.select("best_epoch", r6("best_accuracy").alias("best_accuracy"))


# ---------------------------------------------------------------------------
# Sampling, splitting, encoding

SAMPLE_N = 500


@register("sample_exact", f"""
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE_N}
""")
def q_sample_exact(spark, sf_dir):
    return M.sample_exact(table(spark, sf_dir, "documents").select("doc_id", "lang"), SAMPLE_N)


_SPLIT_SQL = WITH_CORPUS + """, keyed AS (
  SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS k FROM corpus),
m AS (SELECT CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT) AS m FROM keyed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY k) AS rk FROM keyed)
"""


@register("split_counts", _SPLIT_SQL + """
SELECT CASE WHEN rk <= (SELECT m FROM m) THEN 'validation' ELSE 'train' END AS split,
       CAST(count(*) AS BIGINT) AS n_rows
FROM ranked GROUP BY 1
""")
def q_split_counts(spark, sf_dir):
    train, val = M.split_exact(corpus(spark, sf_dir).select("doc_id"))
    t = train.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("train").alias("split"), "n_rows")
    v = val.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("validation").alias("split"), "n_rows")
    return t.unionByName(v)


@register("split_validation", _SPLIT_SQL + """
SELECT doc_id FROM ranked WHERE rk <= (SELECT m FROM m)
""")
def q_split_validation(spark, sf_dir):
    return M.split_exact(corpus(spark, sf_dir).select("doc_id"))[1]


ENCODE_LEN = 512

ENCODE_SQL = WITH_CORPUS + f""", tok AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}') AS t FROM corpus),
tfc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term
          FROM (SELECT DISTINCT term FROM tfc)),
body AS (SELECT doc_id, t[1:{ENCODE_LEN - 2}] AS b FROM tok),
pos AS (SELECT doc_id, unnest(b) AS term, unnest(range(1, len(b) + 1)) AS p FROM body),
ids AS (SELECT pos.doc_id, pos.p, coalesce(v.term_id + {E.FIRST_TERM_ID}, {E.UNK_ID}) AS tid
        FROM pos LEFT JOIN vocab v ON pos.term = v.term),
seqs AS (SELECT b.doc_id, [{E.BOS_ID}] || coalesce(list(ids.tid ORDER BY ids.p) FILTER (WHERE ids.tid IS NOT NULL), []) || [{E.EOS_ID}] AS s
         FROM body b LEFT JOIN ids ON b.doc_id = ids.doc_id GROUP BY b.doc_id)
"""


@register("encode_fixed", ENCODE_SQL + f"""
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_tokens,
       array_to_string(s || list_transform(range({ENCODE_LEN} - len(s)), lambda x: {E.PAD_ID}), ' ') AS input_ids,
       array_to_string(list_transform(range(len(s)), lambda x: 1) || list_transform(range({ENCODE_LEN} - len(s)), lambda x: 0), ' ') AS attention_mask
FROM seqs
""")
def q_encode_fixed(spark, sf_dir):
    enc = encoded_corpus(spark, sf_dir)
    as_text = lambda col: F.array_join(F.transform(col, lambda x: x.cast("string")), " ")
    return enc.select("doc_id", "n_tokens", as_text(F.col("input_ids")).alias("input_ids"),
                      as_text(F.col("attention_mask")).alias("attention_mask"))


def encoded_corpus(spark, sf_dir) -> DataFrame:
    """The corpus encoded by the vocabulary of all its tokens."""
    tokens = X.token_terms(corpus(spark, sf_dir, by_doc=True))
    return E.encode_fixed(tokens, E.full_vocabulary(X.term_frequencies(tokens)), ENCODE_LEN)


# Model-backed queries register themselves into the same registry.
from credence.plans import ml_queries as _ml_queries  # noqa: E402,F401
