"""The page plan: measure, decide, recognise only what needs it, assemble, summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PageOptions
from ..functions.ranges import page_sets
from ..operators import pages as ops
from ..operators.ocr_words import regroup

#: From rows (doc_id, page_no) of pages to rows of words, with ``error`` where recognition failed.
Recogniser = Callable[[DataFrame], DataFrame]


def select_pages(pages: DataFrame, numbers: list[int] | None) -> DataFrame:
    """Only the pages of a selection; to be applied before anything is read from them."""
    return pages if numbers is None else pages.where(F.col("page_no").isin(numbers))


def recognise(decided: DataFrame, recogniser: Recogniser) -> DataFrame:
    """Runs OCR on the pages that need it and on no others: (doc_id, page_no, text, confidence, error)."""
    needed = decided.where(F.col("ocr_mode").isNotNull()).select("doc_id", "page_no")
    words = recogniser(needed)
    failed = words.where(F.col("error").isNotNull()).groupBy("doc_id", "page_no").agg(F.first("error").alias("error"))
    texts = regroup(words.where(F.col("error").isNull()), ["doc_id", "page_no"])
    ran = needed.join(texts, ["doc_id", "page_no"], "left").join(failed, ["doc_id", "page_no"], "left")
    return ran.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), "confidence", "error")


def process(pages: DataFrame, options: PageOptions | None = None, recogniser: Recogniser | None = None) -> DataFrame:
    """The results of all pages."""
    options = options or PageOptions()
    decided = ops.decide(ops.measure(pages, sort=options.sort), threshold=options.ocr_threshold)
    found = recognise(decided, recogniser) if options.ocr and recogniser else None
    return ops.assemble(decided, found, ocr=options.ocr, sort=options.sort, threshold=options.ocr_threshold)


def page_kinds(results: DataFrame) -> DataFrame:
    """A row a document with the number and the ranges of the pages of each kind."""
    kinds = {
        "pages": F.lit(True), "direct": F.col("method") == "DIRECT", "replaced": F.col("method") == "OCR", "supplemented": F.col("method") == "DIRECT + OCR", "recognised": F.col("method").isin("OCR", "DIRECT + OCR"),
        "failed": F.col("method") == "FAILED", "skipped_ocr": F.col("ocr_reason").isNotNull() & ~F.col("used_ocr"), "low_confidence": F.col("low_confidence"), "complex": F.col("complex_content"), "blank": F.col("blank"),
        "review": F.col("needs_review"), "problem": F.col("is_problem"),
    }
    return page_sets(results, kinds)
