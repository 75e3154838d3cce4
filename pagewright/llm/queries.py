"""Queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import balanced, conversation_trie, decontaminate, fill_middle, html_text, line_dedup, packing, pii, quality_model, quality_rules, secrets, simhash, suffix_dedup
from .common import prepare, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.report(decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.learn(documents, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup.report(line_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.report(pii.with_surrogates(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    trusted = quality_rules.trusted_of(table(spark, sf_dir, "labels"))
    return quality_rules.report(quality_rules.verdicts(table(spark, sf_dir, "documents"), trusted))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.report(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fill_middle.report(fill_middle.rearranged(table(spark, sf_dir, "documents")))


def op12_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return balanced.report(balanced.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; tests hold the others against brute force."""
    return {
        "op1_decontaminate": decontaminate.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "op11_fill_middle": fill_middle.ORACLE,
        "op13_conversation_trie": conversation_trie.ORACLE,
    }
