"""Page results as text: a page, a document, a summary, and the files they are written to."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InputError
from ..functions.ranges import page_sets
from ..functions.text import percent, zero_padded
from ..sources.rows import map_rows
from . import files


def page_text() -> Column:
    """A page with its marker, labels and text."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    confidence = F.when(F.col("ocr_confidence").isNotNull(), line(", confidence ", percent(F.col("ocr_confidence") / 100))).otherwise(F.lit(""))
    reason = F.when(F.col("ocr_reason").isNotNull() & F.col("used_ocr"), line("[OCR REASON: ", F.col("ocr_reason"), confidence, "]"))
    head = F.concat(
        F.array(line("--- PAGE ", F.col("page_no").cast("string"), " ---"), line("[EXTRACTION: ", F.col("method"), "]")), F.array_compact(F.array(reason)),
        F.transform("warnings", lambda w: line("[WARNING: ", w, "]")), F.transform("notes", lambda n: line("[NOTE: ", n, "]")),
    )
    extra = F.when(F.col("method") == "DIRECT + OCR", line("[OCR TEXT FROM PAGE IMAGE - may repeat text above]\n", F.coalesce(F.nullif(F.col("ocr_text"), F.lit("")), F.lit("(no text recognized)"))))
    body = F.array_compact(F.array(F.when(F.col("text") != "", F.col("text")), extra))
    return F.concat(F.array_join(head, "\n"), F.when(F.size(body) > 0, line("\n\n", F.array_join(body, "\n\n"))).otherwise(F.lit("")), F.lit("\n"))


def document_pieces(results: DataFrame, page_counts: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, piece): each document's heading, then its pages in order; ``page_counts`` has doc_id and page_count.

    The heading names the pages: Spark works the results out again for it, unless ``numbers`` has their doc_id and page_no.
    """
    pages = results.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.concat(F.lit("\n"), page_text()).alias("piece"))
    extracted = page_sets(results if numbers is None else numbers, {"pages": F.lit(True)}).join(page_counts, "doc_id")
    head = F.concat(
        F.lit("[SOURCE: "), F.regexp_replace("doc_id", "^.*/", ""), F.lit("]\n[PAGES IN DOCUMENT: "), F.col("page_count").cast("string"), F.lit(" | PAGES EXTRACTED: "), F.col("pages.ranges"),
        F.lit("]\n[RAW EXTRACTION - not cleaned, summarized or reordered. [WARNING] lines mark pages that may need review.]\n"),
    )
    return pages.unionAll(extracted.select("doc_id", F.lit(-1).cast("long"), head))


def write_documents(results: DataFrame, page_counts: DataFrame, folder: str, *, numbers: DataFrame | None = None, mode: str = "error") -> None:
    """A text file for each document, ``doc_id`` with the ending .txt."""
    files.save(document_pieces(results, page_counts, numbers), folder, name=files.file_name(F.col("doc_id"), ".txt"), order=["page_no"], mode=mode)


def summaries(sets: DataFrame, page_counts: DataFrame, *, ocr: bool = False) -> DataFrame:
    """(doc_id, summary): the counts and ranges of pages of each kind; ``sets`` from ``plans.pages.page_kinds``."""
    c = F.col
    n = lambda k: c(f"{k}.n").cast("string")
    some = lambda k: c(f"{k}.n") > 0
    shown = lambda k: F.concat(n(k), F.lit(" page(s)"), F.when(some(k), F.concat(F.lit("  ["), c(f"{k}.ranges"), F.lit("]"))).otherwise(F.lit("")))
    added = F.when(some("supplemented"), F.concat(F.lit("  ("), n("replaced"), F.lit(" replaced, "), n("supplemented"), F.lit(" added to direct text)"))).otherwise(F.lit(""))
    rows = (
        (F.lit(True), "Input file:            ", c("doc_id")),
        (F.lit(True), "Pages:                 ", F.concat(n("pages"), F.when(c("pages.n") != c("page_count"), F.concat(F.lit(" of "), c("page_count").cast("string"))).otherwise(F.lit("")))),
        (F.lit(True), "Direct extraction:     ", shown("direct")),
        (F.lit(ocr), "OCR fallback:          ", F.concat(shown("recognised"), added)),
        (F.lit(not ocr) & some("skipped_ocr"), "Would benefit from OCR: ", F.concat(shown("skipped_ocr"), F.lit("  -> rerun with --ocr"))),
        (some("failed"), "Extraction failed:     ", shown("failed")),
        (F.lit(True), "Low-confidence pages:  ", shown("low_confidence")),
        (F.lit(True), "Non-text content:      ", shown("complex")),
        (some("blank"), "Blank pages:           ", shown("blank")),
        (F.lit(True), "Pages needing review:  ", F.when(some("review"), c("review.ranges")).otherwise(F.lit("none"))),
    )
    lines = F.array_compact(F.array(*(F.when(condition, F.concat(F.lit(label), value)) for condition, label, value in rows)))
    return sets.join(page_counts, "doc_id").select("doc_id", F.array_join(lines, "\n").alias("summary"))


def problem_images(results: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, page_no, image_name) of the pages whose image is to be saved."""
    held = results.where("is_problem").join(page_counts, "doc_id")
    return held.select("doc_id", "page_no", F.concat(F.lit("page_"), zero_padded(F.col("page_no"), F.col("page_count")), F.lit(".png")).alias("image_name"))


def save_images(images: DataFrame, render: Callable[[str, int], bytes], folder: str) -> int:
    """Renders each image on the executors; the driver, whose folder it is, takes one partition at a time and writes the files."""

    def rows(doc_id: str, page_no: int, image_name: str) -> list[dict]:
        return [{"place": f"{Path(doc_id).stem}_problem_pages/{image_name}", "image": render(doc_id, page_no)}]

    n = 0
    for r in map_rows(images.select("doc_id", "page_no", "image_name"), rows, "place string, image binary").toLocalIterator():
        target = Path(folder, r["place"])
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(r["image"])
        n += 1
    return n


def write_text(path: str | Path, content: str) -> None:
    """Writes a file as a whole or not at all."""
    path = Path(path)
    part = path.with_name(f"{path.name}.tmp")
    try:
        part.write_text(content, encoding="utf-8", newline="\n")
        os.replace(part, path)
    except OSError as error:
        part.unlink(missing_ok=True)
        raise InputError(f"Could not write {path}: {error.strerror or error}") from None
