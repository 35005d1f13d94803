"""Parquet table sources and the labelled ``corpus`` relation built from them.

``corpus`` is the article relation every detector/profiling operator reads:
``documents`` joined with ``labels`` on ``doc_id``; ``is_fake`` is the
``toxic`` flag, ``dataset`` is the language, ``title`` is synthesised from the
text (the French source of the reference has no title either).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.labels import label_of
from credence.functions.text import synth_title

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    """articles(doc_id, title, text, lang, source, is_fake, label, dataset).

    A projection needs no exchange beyond what the join with ``labels`` asks
    for: none while the labels are broadcast.  With ``by_doc`` the documents
    are hash-partitioned by ``doc_id`` before the join, which a sort-merge join
    needs anyway; then every later per-document aggregation (term counts,
    norms, distances) runs without another exchange, and the raw text --
    smaller than its uni+bigram term table -- is the only thing shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if by_doc:
        # An explicit partition count (the session's shuffle width) keeps this a
        # plain hash partitioning: adaptive execution does not coalesce it, so
        # checkpoints downstream still report ``hashpartitioning(doc_id)``.
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (docs.join(labels, "doc_id")
            .select("doc_id",
                    synth_title("text").alias("title"),
                    "text", "lang", "source",
                    (F.col("toxic") == 1).alias("is_fake"))
            .withColumn("label", label_of("is_fake"))
            .withColumn("dataset", F.col("lang")))


# SQL text of the same relation, for DuckDB oracles (and Spark SQL).
CORPUS_SQL = """
SELECT d.doc_id,
       substring(d.text, 1, 100) || '...' AS title,
       d.text, d.lang, d.source,
       (l.toxic = 1) AS is_fake,
       CASE WHEN l.toxic = 1 THEN 'FAKE' ELSE 'REAL' END AS label,
       d.lang AS dataset
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
