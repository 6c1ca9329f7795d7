"""One query for each operator, over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.llm import substring_dedup as substrings
from qrelia.llm import suffix_dedup as suffixes
from qrelia.llm.conversation_repair import conversation_digests, damage, repair_conversations
from qrelia.llm.decontamination import find_contamination
from qrelia.llm.html_main_text import extract_main_text
from qrelia.llm.lm_scoring import score_texts
from qrelia.llm.order_minhash import near_duplicates
from qrelia.llm.packing import pack_documents
from qrelia.llm.quality_classifier import classify
from qrelia.llm.quality_rules import quality_rules
from qrelia.llm.spelling_variants import spelling_variants
from qrelia.llm.tables import table
from qrelia.llm.token_files import token_file_digests
from qrelia.llm.url_filter import ALLOW, BLOCK, filter_urls

URL_RULES = [
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
]


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.substring_dedup(docs, finish=substrings.digest_words, fields=substrings.DIGEST)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = suffixes.suffix_dedup(docs, finish=suffixes.digest_bytes, fields=suffixes.DIGEST)
    return digests.withColumn("has_repeats", F.col("n_removed") > 0)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), damage_every=199)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = damage(table(spark, sf_dir, "conversations"))
    return conversation_digests(repair_conversations(hurt, present="present"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_url_filter": op2_url_filter,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_main_text": op9_html_main_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_files": op13_token_files,
}
