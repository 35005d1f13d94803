"""The queries of this subpackage: one for each operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import sql
from credence.llm.blocks import import_on_workers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            import_on_workers(spark)
            return f(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


@query("op2_seed_extend", sql.SEED_EXTEND)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.seed_extend import remove_repeated_passages
    return (remove_repeated_passages(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


@query("op5_bwt_merge", sql.BWT_MERGE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.bwt import remove_repeated_bytes
    return (remove_repeated_bytes(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))


@query("op8_setsketch", sql.SETSKETCH)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.setsketch import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_two_tier_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from credence.llm.bpe import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op10_best_two_fit")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from credence.llm.packing import pack, token_pieces
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op3_iblt")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.iblt import fingerprint_versions
    return fingerprint_versions(table(spark, sf_dir, "documents"))


@query("op7_pseudo_likelihood")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.lm import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


@query("op1_js_divergence", sql.QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.quality import quality_rules
    return (quality_rules(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


@query("op9_range_join", sql.RANGE_JOIN)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.urls import RULES, judge_urls, rule_table
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


@query("op4_derivatives")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.warc import derive, page_responses
    records = derive(page_responses(table(spark, sf_dir, "pages")))
    return records.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "source_content_type", "source_digest", "block_digest", "n_links", "title",
                          F.octet_length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"),
                          F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"))


@query("op12_ftrl")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_grammar_repair", sql.REPAIR)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.repair import damaged, repair_conversations
    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), conversations.select(F.col("conv_id").cast("long").alias("conv_id")))


@query("op11_turn_matrix_trie", sql.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.llm.trie import panels, prefix_trie, rebuilt
    return prefix_trie(panels(*rebuilt(table(spark, sf_dir, "conversations"))))
