"""Measuring pages, deciding about OCR and review, and putting page results together.

A row of pages has doc_id, page_no, blocks, images, fonts, drawing_count, table_count, x0, y0, width, height, raster
(w, h, stride, samples) and error, which says why a page could not be read.  ``measure`` adds the metrics, ``decide``
the OCR mode and reason, ``assemble`` the result of the page once the OCR results of those that need one are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import clean_text, count_chars, count_math, once, percent, solid_metrics
from . import layout

METRICS = (
    "chars", "garbage_ratio", "alnum_ratio", "ink_ratio", "nontext_ink_ratio", "image_count", "image_coverage", "drawing_count", "table_count",
    "block_count", "median_block_chars", "multi_column", "order_jumps", "has_math",
)
RESULT = ("doc_id", "page_no", "text", "method", "ocr_text", "ocr_reason", "ocr_confidence", "blank", "low_confidence", "complex_content", "warnings", "notes", "needs_review", "used_ocr", "is_problem")


def texts(of: Column, *pairs: tuple[Column, Column]) -> Column:
    """An array of the messages whose condition holds."""
    return F.array_compact(F.concat(of, F.array(*(F.when(condition, message) for condition, message in pairs)))) if pairs else of


def none() -> Column:
    return F.lit(None).cast("string")


def in_math_fonts(fonts: Column) -> Column:
    """Whether a font of formulas is among the names; null is no font."""
    return F.array_join(F.coalesce(fonts, F.array().cast("array<string>")), " ").rlike(f"(?i){C.MATH_FONTS}")


def measure(pages: DataFrame, *, sort: bool = False) -> DataFrame:
    """The page's text and metrics; of a page with an error the text is empty and the metrics are the defaults."""
    held = pages.withColumn("blocks", F.when(F.col("error").isNull(), layout.text_blocks(F.col("blocks"), sort)).otherwise(F.slice("blocks", 1, 0)))
    held = once(held, {"text": F.coalesce(clean_text(layout.joined_text(F.col("blocks"))), F.lit(""))})
    held = once(held, {"_solid": solid_metrics(F.col("text")), "_math": count_math(F.col("text"))})
    held = layout.with_ink(held, "_ink", "raster", "blocks", "x0", "y0")
    held = held.withColumn("_shares", layout.image_shares(F.coalesce("images", F.array().cast(pages.schema["images"].dataType)), F.col("x0"), F.col("y0"), F.col("width"), F.col("height")))
    ok = F.col("error").isNull()
    values = {
        **{k: F.col(f"_solid.{k}") for k in ("chars", "garbage_ratio", "alnum_ratio")},
        "ink_ratio": F.when(ok, F.col("_ink.ink_ratio")).otherwise(0.0), "nontext_ink_ratio": F.when(ok, F.col("_ink.nontext_ink_ratio")).otherwise(0.0),
        "image_count": F.when(ok, layout.image_count(F.col("_shares"))).otherwise(0), "image_coverage": F.when(ok, layout.image_coverage(F.col("_shares"))).otherwise(0.0),
        "drawing_count": F.when(ok, F.coalesce("drawing_count", F.lit(0))).otherwise(0), "table_count": F.when(ok, F.coalesce("table_count", F.lit(0))).otherwise(0),
        "block_count": F.coalesce(F.nullif(F.size("blocks"), F.lit(-1)), F.lit(0)), "median_block_chars": F.coalesce(layout.median_chars(F.col("blocks")), F.lit(0.0)),
        "multi_column": F.coalesce(layout.multi_column(F.col("blocks"), F.col("x0"), F.col("width")), F.lit(False)), "order_jumps": F.coalesce(layout.order_jumps(F.col("blocks")), F.lit(0)),
        "has_math": ok & (in_math_fonts(F.col("fonts")) | (F.col("_math") >= C.MATH_LEAST)),
    }
    return held.withColumns(values).drop("_ink", "_shares", "_solid", "_math", "images", "fonts")


def low_quality(threshold: int = C.OCR_THRESHOLD) -> tuple[Column, Column]:
    """Code and reason of a page whose direct text is missing, garbled or suspiciously short; null if it is none."""
    chars = F.col("chars")
    cases = (
        ((chars == 0) & (F.col("ink_ratio") < C.BLANK_INK), none(), none()),
        (chars == 0, F.lit("no_text"), F.lit("no text layer, but the page has visible content")),
        (F.col("garbage_ratio") > C.GARBAGE, F.lit("garbled"), F.concat(F.lit("text layer looks garbled ("), percent(F.col("garbage_ratio")), F.lit(" unreadable characters)"))),
        ((chars >= C.ALNUM_FROM_CHARS) & (F.col("alnum_ratio") < C.LEAST_ALNUM), F.lit("few_letters"), F.concat(F.lit("text layer looks garbled (only "), percent(F.col("alnum_ratio")), F.lit(" letters/digits)"))),
        (
            (chars < threshold) & ((F.col("nontext_ink_ratio") >= C.NONTEXT_INK) | (F.col("image_coverage") >= C.WEAK_TEXT_COVERAGE)),
            F.lit("short"), F.concat(F.lit("only "), chars.cast("string"), F.lit(" characters of text, but the page has other visible content")),
        ),
    )
    code, reason = none(), none()
    for condition, c, r in reversed(cases):
        code, reason = F.when(condition, c).otherwise(code), F.when(condition, r).otherwise(reason)
    return code, reason


def decide(measured: DataFrame, *, threshold: int = C.OCR_THRESHOLD) -> DataFrame:
    """Adds quality_code, ocr_mode (replace, supplement or null) and ocr_reason."""
    code, reason = low_quality(threshold)
    coded = measured.withColumns({"quality_code": code, "_reason": reason})
    large = F.col("image_coverage") >= C.SUPPLEMENT_COVERAGE
    mode = F.when(F.col("error").isNotNull(), "replace").when(F.col("quality_code").isin("no_text", "garbled", "few_letters"), "replace").when(F.col("quality_code").isNotNull() | large, "supplement")
    covered = F.concat(F.lit("images cover "), percent(F.col("image_coverage")), F.lit(" of the page and may contain text"))
    why = F.when(F.col("error").isNotNull(), "direct extraction failed").otherwise(F.coalesce("_reason", F.when(large, covered)))
    return once(coded, {"ocr_mode": mode, "ocr_reason": why}).drop("_reason")


def complex_reasons() -> Column:
    """Why plain text may not hold what the page shows."""
    number = lambda c, tail: F.concat(F.col(c).cast("string"), F.lit(tail))
    covered, many = F.col("image_coverage") >= C.COMPLEX_COVERAGE, F.col("image_count") >= C.COMPLEX_IMAGES
    return texts(
        F.array().cast("array<string>"),
        (covered, F.concat(F.lit("images cover "), percent(F.col("image_coverage")), F.lit(" of the page"))),
        (~covered & many, number("image_count", " images")),
        (F.col("drawing_count") >= C.COMPLEX_DRAWINGS, number("drawing_count", " vector drawing elements - possible diagram, chart or flowchart")),
        (F.col("table_count") > 0, number("table_count", " table(s) detected - text kept, table layout not reconstructed")),
        ((F.col("block_count") >= C.FRAGMENTS) & (F.col("median_block_chars") < C.FRAGMENT_CHARS), F.concat(F.lit("fragmented text ("), number("block_count", " short text blocks) - possible diagram labels"))),
    )


def assemble(decided: DataFrame, recognised: DataFrame | Column | None = None, *, ocr: bool = False, sort: bool = False, threshold: int = C.OCR_THRESHOLD) -> DataFrame:
    """Page results.  ``recognised`` has doc_id, page_no, text, confidence and error of the pages that OCR was run on.

    Where the pages hold it already, it is a column of theirs (text, confidence, error; null where OCR was not run), and no
    page is worked out twice or moved for a join.
    """
    if ocr and isinstance(recognised, Column):
        seen = once(decided, {"_seen": recognised})
        seen = once(seen, {"_text": F.when(F.col("_seen").isNotNull(), clean_text(F.coalesce("_seen.text", F.lit(""))))})
        more = {"_conf": F.col("_seen.confidence"), "_error": F.col("_seen.error"), "_chars": count_chars(F.col("_text")), "_signs": count_math(F.col("_text")), "_ran": F.when(F.col("_seen").isNotNull(), True)}
        pages = seen.withColumns(more)
    elif ocr and recognised is not None:
        seen = once(recognised.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("_text"), F.col("confidence").alias("_conf"), F.col("error").alias("_error")), {"_text": clean_text(F.col("_text"))})
        found = seen.withColumns({"_chars": count_chars(F.col("_text")), "_signs": count_math(F.col("_text")), "_ran": F.lit(True)})
        pages = decided.join(found, ["doc_id", "page_no"], "left")
    else:
        empty = {"_text": "string", "_conf": "double", "_error": "string", "_chars": "int", "_signs": "int", "_ran": "boolean"}
        pages = decided.withColumns({k: F.lit(None).cast(kind) for k, kind in empty.items()})
    pages = once(pages, {"_reasons": complex_reasons()})
    failed, need, replace = F.col("error").isNotNull(), F.col("ocr_mode").isNotNull(), F.col("ocr_mode") == "replace"
    done = need & F.col("_ran").isNotNull() & F.col("_error").isNull()
    lost = need & F.col("_ran").isNotNull() & F.col("_error").isNotNull()
    unsure = F.col("_conf") < C.LOW_CONFIDENCE
    little = replace & (F.col("_chars") < threshold)
    problems = texts(
        F.array().cast("array<string>"),
        (unsure, F.concat(F.lit("mean OCR confidence "), percent(F.col("_conf") / 100))),
        (little, F.concat(F.lit("OCR recovered only "), F.col("_chars").cast("string"), F.lit(" characters"))),
    )
    doubtful = done & (F.coalesce(unsure, F.lit(False)) | F.coalesce(little, F.lit(False)))
    reasons = F.col("_reasons")
    is_complex = ~failed & (F.size(reasons) > 0)
    jumps = ~failed & F.lit(not sort) & (F.col("order_jumps") >= C.JUMPS_LEAST) & (F.col("order_jumps") >= C.JUMPS_SHARE * F.greatest(F.col("block_count") - 1, F.lit(1)))
    math = F.col("has_math") | (F.col("_signs") >= C.MATH_LEAST)
    warnings = texts(
        F.array().cast("array<string>"),
        (failed, F.concat(F.lit("DIRECT EXTRACTION FAILED ("), F.col("error"), F.lit(")"))),
        (F.lit(not ocr) & ~failed & replace, F.concat(F.lit("NO USABLE TEXT LAYER ("), F.col("ocr_reason"), F.lit(") - rerun with --ocr or inspect the page image"))),
        (F.lit(not ocr) & ~failed & need & ~replace, F.concat(F.lit("PAGE TEXT MAY BE INCOMPLETE ("), F.col("ocr_reason"), F.lit(") - rerun with --ocr or inspect the page image"))),
        (lost, F.concat(F.lit("OCR FAILED ("), F.col("_error"), F.lit(")"))),
        (doubtful, F.concat(F.lit("LOW CONFIDENCE EXTRACTION ("), F.array_join(problems, "; "), F.lit(")"))),
        (done & math, F.lit("OCR WAS USED ON MATHEMATICAL CONTENT - formulas need manual review")),
        (is_complex, F.concat(F.lit("PAGE MAY CONTAIN SIGNIFICANT NON-TEXT CONTENT ("), F.array_join(reasons, "; "), F.lit(")"))),
        (jumps, F.lit("TEXT ORDER MAY NOT MATCH THE VISUAL LAYOUT (try --sort)")),
    )
    blank = ~failed & (F.col("chars") == 0) & ~need
    notes = texts(
        F.array().cast("array<string>"),
        (blank, F.lit("PAGE APPEARS BLANK")),
        (~failed & F.col("multi_column"), F.lit("MULTI-COLUMN LAYOUT DETECTED - text kept in the PDF's reading order")),
        (~failed & F.col("has_math") & ~done, F.lit("CONTAINS MATHEMATICAL NOTATION - fractions, subscripts and superscripts may be flattened")),
    )
    method = F.when(done & replace, "OCR").when(done, "DIRECT + OCR").when(failed, "FAILED").otherwise("DIRECT")
    out = once(pages, {
        "method": method, "ocr_confidence": F.when(done, F.col("_conf")), "blank": blank, "complex_content": is_complex, "warnings": warnings, "notes": notes,
        "low_confidence": doubtful | lost | (F.lit(not ocr) & ~failed & F.coalesce(replace, F.lit(False))),
    })
    # texts stay outside of it, so that they are not read where nobody asks for them
    out = out.withColumns({"text": F.when(done & replace, F.col("_text")).otherwise(F.col("text")), "ocr_text": F.when(done & ~replace, F.col("_text")).otherwise(F.lit(""))})
    out = out.withColumns({"needs_review": F.size("warnings") > 0, "used_ocr": F.contains("method", F.lit("OCR"))})
    out = out.withColumn("is_problem", F.col("needs_review") | F.col("used_ocr") | F.col("ocr_reason").isNotNull())
    return out.select(*RESULT, *METRICS)
