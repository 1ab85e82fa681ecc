"""Queries of this subpackage: opN_<name> for each operator N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread
from . import chat, mixing, trie
from .ann import nearest
from .common import table
from .crossing import align_tokenizers
from .lines import remove_shared_blocks
from .minhash import near_duplicates
from .packing import packed
from .pivots import ORACLE as TOP_SCORES
from .pivots import top_scores
from .quality import classified
from .rules import apply_rules, labelled_statistics, learn
from .substring import remove_repeated_spans
from .suffix import remove_repeated_bytes

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; a small one in few files over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_spans(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_shared_blocks(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = apply_rules(docs, learn(labelled_statistics(docs, table(spark, sf_dir, "labels"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return kept.select("doc_id", "n_bytes", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_packing": op8_packing,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_alignment": op12_token_alignment,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.ORACLE,
        "op11_prefix_trie": trie.ORACLE,
        "op13_exact_top_k": TOP_SCORES,
    }
