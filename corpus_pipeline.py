"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the last return the
columns of documents.  ``run`` writes each stage's result as Parquet in the shared folder that the session names in
spark.checkpoint.dir and reads it again, so a lost executor costs one stage at most.  What a stage has read goes once the
next table is written.

Defined cases, in every stage: a null text is an empty one; rows that repeat a doc_id are rows of their own, but for
stages that compare texts, where equal rows go together; a row without doc_id is never a repeat or near duplicate of
another; an empty table gives an empty table; columns beside those of documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, line_dedup, packing, quality_rules, similar
from pagewright.llm.common import prepare, removed, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: empty texts too, as they have fewer words than a document must have."""
    prepare(spark)
    return quality_rules.kept_documents(docs, quality_rules.trusted_of(table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; n_chars is counted anew.  A document that is nothing else is left empty."""
    prepare(spark)
    cleaned = line_dedup.without_repeats(docs)
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id; all empty texts are one group."""
    prepare(spark)
    return similar.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; others are unchanged."""
    prepare(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and offset; an empty text is a piece of the end id alone."""
    prepare(spark)
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed),
]

#: Scores, fingerprints and tokens are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
