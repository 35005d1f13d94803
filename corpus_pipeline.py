"""Documents to training sequences: quality rules, near-duplicates, repeated passages, packing.

Every stage takes the documents that its predecessor kept, all of them, and
returns documents again; the last returns the packed pieces.  Rows are dropped
or texts shortened only by a stage's own decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.blocks import import_on_workers, restrict
from credence.llm.packing import pack, token_pieces
from credence.llm.quality import quality_rules
from credence.llm.seed_extend import remove_repeated_passages
from credence.llm.setsketch import near_duplicates
from credence.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself.

    A null or empty text is rejected (too few words), whatever its doc_id;
    rows with a null or repeated doc_id stay or go by their own text and lang.
    An empty table stays empty.  Columns other than those of documents go.
    """
    import_on_workers(spark)
    # The verdict depends on text and lang alone; their digest carries it back to every row.
    key = F.md5(F.concat_ws("\u0000", F.coalesce("lang", F.lit("\u0001")), F.coalesce("text", F.lit(""))))
    keyed = docs.select(*COLUMNS, key.alias("__judged"))
    return restrict(keyed, quality_rules(keyed, id_col="__judged").where("not kept").withColumnRenamed("doc_id", "__judged"), "left_anti", "__judged").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest doc_id.

    A null or blank text is in no group and stays, as does a row with a null
    doc_id; rows that share a doc_id are one document, which stays or goes
    whole.  An empty table stays empty.
    """
    import_on_workers(spark)
    return restrict(docs.select(*COLUMNS), near_duplicates(docs, shingle_words=5, percent=80, rows=4).where("not kept"), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has.

    A text without such a passage stays as it is; of another one the kept words
    are joined by one space.  A document that has lost all its words goes.
    """
    import_on_workers(spark)
    left = remove_repeated_passages(docs, keep=("text", "lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    touched = F.col("n_removed") > 0
    return left.select("doc_id", F.when(touched, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                       F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place.

    A null or empty text is one piece, the end mark; a null doc_id is carried
    as it is; repeated rows are packed each.  An empty table gives no pieces.
    """
    import_on_workers(spark)
    import public_tokenizers
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", packing)]
ORACLE_SQL = None          # tokenising is not SQL; tests/llm holds the whole against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written as Parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
