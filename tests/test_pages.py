"""Pages: helpers, layout, decisions, OCR only where needed, results as text."""

import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.config import MATH_SIGNS, InputError, PageOptions
from pagewright.functions import text as X
from pagewright.functions.ranges import page_list, parse_page_range
from pagewright.operators import layout, ocr_words, pages
from pagewright.plans import outputs, queries
from pagewright.plans import pages as plan
from pagewright.sinks import files
from pagewright.sinks import pages as sinks
from pagewright.sources import ocr, pdf
from pagewright.sources.rows import map_rows

BLOCK = "struct<seq:int,x0:double,y0:double,x1:double,y1:double,text:string,type:int>"
PAGES = f"doc_id string, page_no int, blocks array<{BLOCK}>, images array<struct<x0:double,y0:double,x1:double,y1:double>>, fonts array<string>, drawing_count int, table_count int, x0 double, y0 double, width double, height double, raster struct<w:int,h:int,stride:int,samples:binary>, error string"
WORDS = ocr.WORDS
PROSE = "The relational model keeps data in tables whose rows are facts, and queries say what is wanted, not how to find it."


def block(seq, x0, y0, x1, y1, text, kind=0):
    return (seq, float(x0), float(y0), float(x1), float(y1), text, kind)


def raster(ink=(), w=306, h=396, stride=306, paper=255):
    grey = np.full((h, stride), paper, np.uint8)
    for x0, y0, x1, y1 in ink:
        grey[int(y0 / 2) : int(y1 / 2), int(x0 / 2) : int(x1 / 2)] = 0 if paper > 127 else 255
    return (w, h, stride, bytearray(grey.tobytes()))


def page(n, blocks=(), images=(), fonts=(), drawings=0, tables=0, ink=None, error=None, paper=255, doc="/d/mixed.pdf"):
    boxes = [b[1:5] for b in blocks if b[6] == 0]
    return (doc, n, list(blocks), [tuple(map(float, i)) for i in images], list(fonts), drawings, tables, 0.0, 0.0, 612.0, 792.0, raster(boxes if ink is None else ink, paper=paper), error)


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), PAGES)


def mixed(spark):
    big = (50, 100, 560, 600)
    return frame(
        spark,
        page(1, [block(0, 50, 50, 550, 200, PROSE)]),
        page(2, [block(0, 50, 20, 200, 40, "Figure 1")], images=[big], ink=[(50, 20, 200, 40), big]),
        page(3, [block(i, 50 + 100 * (i % 3), 60 * i, 100 + 100 * (i % 3), 60 * i + 20, f"Step {i}") for i in range(12)], drawings=80),
        page(4, [block(0, 50, 50, 550, 300, PROSE)], tables=1),
        page(5),
        page(6, [block(0, 50, 50, 550, 200, PROSE)], paper=20),
    )


def counting(spark, tmp_path, text="Recognised words here on the page that are plenty of text to be sure of what it says.", conf=91.0, fails=()):
    """A stand-in for OCR that writes down which pages reach it."""
    log = str(tmp_path)

    def rows(d, n):
        open(f"{log}/{n}", "a").write("x")
        if n in fails:
            return [{"doc_id": d, "page_no": n, "error": "RuntimeError: no"}]
        return [{"doc_id": d, "page_no": n, "word_idx": i, "level": 5, "block_num": 1, "par_num": 1, "line_num": i // 5, "text": w, "conf": conf} for i, w in enumerate(text.split())]

    return lambda needed: map_rows(needed, rows, WORDS)


def test_page_ranges(spark):
    assert parse_page_range("1-3", 10) == [1, 2, 3] and parse_page_range("1,3, 5", 10) == [1, 3, 5] and parse_page_range("1-5,8,10-12", 12) == [1, 2, 3, 4, 5, 8, 10, 11, 12] and parse_page_range("9-", 10) == [9, 10]
    for spec, said in (("0", "Invalid"), ("5-2", "Invalid"), ("a", "Use forms"), ("1-20", "past the end"), ("3,,x", "Invalid"), (" , ", "No pages"), ("9-", "Invalid")):
        with pytest.raises(InputError, match=said):
            parse_page_range(spec, 8)
    df = spark.createDataFrame([([8, 1, 2, 3, 13, 9],), ([],), ([5],), ([4, 4, 3],), ([1, 3, 5],), (list(range(200_000, 0, -1)),)], "p array<int>")
    assert [r[0] for r in df.select(page_list(F.col("p"))).collect()] == ["1-3, 8-9, 13", "", "5", "3-4", "1, 3, 5", "1-200000"]


def test_characters_like_python(spark):
    points = [c for c in range(0x3002) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    rows = df.select("c", X.count_chars(F.col("t")).alias("n"), X.clean_text(F.col("t")).alias("clean"), X.squeezed(F.col("t")).alias("squeezed")).collect()
    for r in rows:
        ch = chr(r.c)
        assert r.n == 2 + (not ch.isspace()), hex(r.c)
        assert r.squeezed == " ".join(f"a{ch}b".split()), hex(r.c)
        expected = "\n" if ch == "\r" else "" if unicodedata.category(ch) == "Cc" and ch not in "\n\t" else ch
        assert r.clean == f"a{expected}b", hex(r.c)


def test_signs_like_python(spark):
    points = [c for c in range(0x10FFFF) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    df = spark.createDataFrame([(c, f"a{chr(c)}{chr(c)}b") for c in points], "c int, t string").select("c", X.count_math(F.col("t")).alias("n"))
    assert {r.c for r in df.where("n = 2").collect()} == {*map(ord, MATH_SIGNS)} and not df.where("n not in (0, 2)").count()


def test_signs_are_not_tried_one_by_one(spark):
    """Letters are ruled out at once: signs take no longer than a few times what white space takes."""
    texts = spark.range(40).select(F.repeat(F.concat(F.lit("abcdefgh "), "id"), F.lit(20_000)).alias("t")).coalesce(1).cache()
    texts.count()

    def seconds(counted):
        def once():
            start = time.perf_counter()
            texts.agg(F.sum(counted)).collect()
            return time.perf_counter() - start

        return min(once() for _ in range(3))

    assert seconds(X.count_math(F.col("t"))) < 3 * seconds(X.count_chars(F.col("t")))


def test_metrics_look_for_space_once(spark):
    plan = queries.text_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p{Z}") == 1


def test_clean_text(spark):
    raw = "\n\na\x00b\tc\x0c  \r\nd   \re\n\n\n\n\n\nf  g  \n  \n"
    df = spark.createDataFrame([(raw,), ("",), ("\n",), ("x" + " " * 5000 + "y",)], "t string")
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["ab\tc\nd\ne\n\n\nf  g", "", "", "x" + " " * 5000 + "y"]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(62.5,), (2.675,), (0.5,)], "v double")
    rows = df.select(X.fixed_udf("v", F.lit(0)), X.fixed_udf("v", F.lit(2)), X.percent(F.col("v") / 100)).collect()
    assert tuple(rows[0]) == ("62", "62.50", "62%") and rows[1][1] == "2.67" and rows[2][1] == "0.50"


def test_ink():
    w, h, stride, samples = raster([(100, 100, 200, 200)], stride=310)
    total, outside = layout.ink(bytes(samples), w, h, stride, [], 0, 0)
    assert total == outside == 2500 / (306 * 396)
    assert layout.ink(bytes(samples), w, h, stride, [(100.0, 100.0, 200.0, 200.0)], 0, 0) == (total, 0.0)
    assert layout.ink(bytes(samples), w, h, stride, [(109.0, 0.0, 800.0, 800.0)], 0, 0)[1] == 3 * 50 / (306 * 396)
    assert layout.ink(b"", 0, 0, 0, [], 0, 0) == (0.0, 0.0)
    assert layout.ink(bytes([0, 200, 0, 200]), 2, 2, 2, [], 0, 0) == (0.5, 0.5)  # the darkest of equally frequent levels is the background


def test_layout(spark):
    columns = [block(i, 40 if i < 2 else 320, 100 * (i % 2), 290 if i < 2 else 570, 100 * (i % 2) + 90, PROSE) for i in range(4)]
    jumpy = [block(i, 50, 700 - 60 * i, 200, 720 - 60 * i, "word") for i in range(4)]
    df = frame(spark, page(1, columns), page(2, jumpy), page(3, [block(0, 0, 0, 9, 9, " "), block(1, 0, 0, 9, 9, "img", 1), block(3, 1, 50, 2, 60, "b"), block(2, 5, 5, 9, 9, "\nc\n")]))
    kept = df.withColumn("b", layout.text_blocks(F.col("blocks")))
    rows = kept.select("page_no", layout.multi_column(F.col("b"), F.col("x0"), F.col("width")).alias("m"), layout.order_jumps(F.col("b")).alias("j"), layout.joined_text(F.col("b")).alias("t"), layout.median_chars(F.col("b")).alias("n")).orderBy("page_no").collect()
    assert [(r.m, r.j) for r in rows] == [(True, 0), (False, 3), (False, 0)]
    assert rows[2].t == "c\n\nb" and rows[2].n == 1.0
    sorted_by_place = frame(spark, page(1, jumpy)).select(layout.text_blocks(F.col("blocks"), True).alias("b")).first().b
    assert [b.seq for b in sorted_by_place] == [3, 2, 1, 0]
    flat = df.select("doc_id", "page_no", "x0", "width")
    blocks = kept.select("doc_id", "page_no", F.explode("b").alias("k")).select("doc_id", "page_no", "k.*")
    assert {r.page_no: r.multi_column for r in layout.multi_column_rows(blocks, flat, ["doc_id", "page_no"]).collect()} == {1: True, 2: False, 3: False}
    shares = layout.image_shares(F.col("images"), F.col("x0"), F.col("y0"), F.col("width"), F.col("height"))
    r = frame(spark, page(1, images=[(-100, 0, 306, 792), (600, 0, 700, 792), (0, 0, 306, 792), (900, 0, 950, 10), (5, 5, 5, 50)])).select(layout.image_count(shares).alias("n"), layout.image_coverage(shares).alias("c")).first()
    assert (r.n, r.c) == (2, 1.0)


def test_words(spark):
    words = [(0, 5, 1, 1, 1, "one", "90"), (1, 5, 1, 1, 1, "two", "x"), (2, 4, 1, 1, 1, "skip", "10"), (3, 5, 1, 1, 2, "three", "-1"), (4, 5, 1, 2, 1, "four", "50"), (5, 5, 1, 1, 1, " ", "9"), (6, 5, 1, 1, 1, "again", "70")]
    df = spark.createDataFrame([("d", 1, *w) for w in words], "doc_id string, page_no int, word_idx int, level int, block_num int, par_num int, line_num int, text string, conf string")
    r = ocr_words.regroup(ocr.words_from(df), ["doc_id", "page_no"]).first()
    assert r.text == "one two\nthree\n\nfour\n\nagain" and r.confidence == 70.0
    assert ocr.missing_languages("eng+fra+deu", ["eng", "osd"]) == ["fra", "deu"] and ocr.missing_languages("eng", []) == []


def test_without_ocr(spark):
    rows = {r.page_no: r for r in plan.process(mixed(spark)).collect()}
    assert {n for n, r in rows.items() if r.needs_review} == {2, 3, 4}
    assert rows[5].blank and rows[5].notes == ["PAGE APPEARS BLANK"] and not rows[6].warnings and rows[6].ink_ratio > 0.1
    assert rows[2].warnings[0].startswith("PAGE TEXT MAY BE INCOMPLETE (only 7 characters of text, but the page has other visible content) - rerun with --ocr")
    assert rows[2].warnings[1] == "PAGE MAY CONTAIN SIGNIFICANT NON-TEXT CONTENT (images cover 53% of the page)"
    assert rows[3].warnings == ["PAGE MAY CONTAIN SIGNIFICANT NON-TEXT CONTENT (80 vector drawing elements - possible diagram, chart or flowchart; fragmented text (12 short text blocks) - possible diagram labels)"]
    assert rows[4].warnings == ["PAGE MAY CONTAIN SIGNIFICANT NON-TEXT CONTENT (1 table(s) detected - text kept, table layout not reconstructed)"]
    lists = plan.page_kinds(plan.process(mixed(spark)))
    counts = spark.createDataFrame([("/d/mixed.pdf", 6)], "doc_id string, page_count int")
    summary = sinks.summaries(lists, counts).first().summary.split("\n")
    assert "Would benefit from OCR: 1 page(s)  [2]  -> rerun with --ocr" in summary and summary[-1] == "Pages needing review:  2-4" and "Blank pages:           1 page(s)  [5]" in summary and "Pages:                 6" in summary
    assert [r.image_name for r in sinks.problem_images(plan.process(mixed(spark)), counts).orderBy("page_no").collect()] == ["page_002.png", "page_003.png", "page_004.png"]


def test_ocr_runs_only_where_needed(spark, tmp_path):
    options = PageOptions(ocr=True)
    rows = {r.page_no: r for r in plan.process(mixed(spark), options, counting(spark, tmp_path)).collect()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2"]
    assert rows[2].method == "DIRECT + OCR" and rows[2].ocr_text.startswith("Recognised words here on the\npage") and rows[2].ocr_confidence == 91.0
    counts = spark.createDataFrame([("/d/mixed.pdf", 6)], "doc_id string, page_count int")
    content = files.text_of(sinks.document_pieces(plan.process(mixed(spark), options, counting(spark, tmp_path)), counts), ["page_no"])
    assert content.startswith("[SOURCE: mixed.pdf]\n[PAGES IN DOCUMENT: 6 | PAGES EXTRACTED: 1-6]\n")
    assert "--- PAGE 2 ---\n[EXTRACTION: DIRECT + OCR]\n[OCR REASON: only 7 characters of text, but the page has other visible content, confidence 91%]\n" in content
    assert "Figure 1\n\n[OCR TEXT FROM PAGE IMAGE - may repeat text above]\nRecognised" in content and content.endswith(f"{PROSE}\n")


def test_scans_failures_and_doubts(spark, tmp_path):
    scan = [(0, 0, 612, 792)]
    pages = frame(spark, page(1, images=scan, ink=[(50, 50, 500, 700)]), page(2, images=scan, ink=[(50, 50, 500, 700)]), page(3, error="ValueError: damaged"), page(4, [block(0, 0, 0, 600, 90, "�" * 30 + "abc")]))
    plain = {r.page_no: r for r in plan.process(pages).collect()}
    assert plain[1].warnings[0].startswith("NO USABLE TEXT LAYER (no text layer, but the page has visible content)") and plain[1].low_confidence
    assert plain[3].method == "FAILED" and plain[3].warnings == ["DIRECT EXTRACTION FAILED (ValueError: damaged)"] and plain[3].ocr_reason == "direct extraction failed"
    assert plain[4].ocr_reason == "text layer looks garbled (91% unreadable characters)"
    read = {r.page_no: r for r in plan.process(pages, PageOptions(ocr=True), counting(spark, tmp_path, text="∑ ∫ √ few", conf=40.0, fails=(2,))).collect()}
    assert read[1].method == "OCR" and read[1].text == "∑ ∫ √ few"
    assert read[1].warnings[:2] == ["LOW CONFIDENCE EXTRACTION (mean OCR confidence 40%; OCR recovered only 6 characters)", "OCR WAS USED ON MATHEMATICAL CONTENT - formulas need manual review"]
    assert read[2].method == "DIRECT" and read[2].warnings[0] == "OCR FAILED (RuntimeError: no)" and read[2].low_confidence
    assert read[3].method == "OCR" and read[3].warnings[0].startswith("DIRECT EXTRACTION FAILED")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2", "3", "4"]


def test_a_file_is_opened_once_for_many_pages(spark, tmp_path):
    """With a stand-in for the reader: pages in portions, one broken page and one broken file."""

    def reader(content):
        if content == b"broken":
            raise OSError("cut off")
        (tmp_path / f"{len(list(tmp_path.iterdir()))}").write_bytes(content)

        def read(n):
            if n == 5:
                raise ValueError("blot")
            return [{"word_idx": 0, "level": 5, "block_num": 1, "par_num": 1, "line_num": 1, "text": f"{content.decode()}{n}", "conf": 80.0}]

        return read

    files = spark.createDataFrame([("a", b"A"), ("b", b"broken"), ("c", b"never asked for")], "doc_id string, content binary")
    needed = spark.createDataFrame([*(("a", n) for n in range(1, 71)), ("b", 1), ("b", 2)], "doc_id string, page_no int")
    rows = {(r.doc_id, r.page_no): r for r in ocr.recogniser(files, reader=reader)(needed).coalesce(1).collect()}
    assert len(rows) == 72 and len(list(tmp_path.iterdir())) == 3
    assert rows["a", 70].text == "A70" and rows["a", 5].error == "ValueError: blot" and rows["b", 2].error == "OSError: cut off"


def test_notes_and_options(spark):
    columns = [block(i, 40 if i < 2 else 320, 100 * (i % 2), 290 if i < 2 else 570, 100 * (i % 2) + 90, PROSE) for i in range(4)]
    jumpy = [block(i, 50, 700 - 60 * i, 200, 720 - 60 * i, PROSE) for i in range(4)]
    df = frame(spark, page(1, columns, fonts=["CMMI10"]), page(2, jumpy), page(3, [block(0, 0, 0, 600, 90, PROSE + " α → β")]))
    rows = {r.page_no: r for r in plan.process(plan.select_pages(df, [1, 2, 3])).collect()}
    assert [n[:12] for n in rows[1].notes] == ["MULTI-COLUMN", "CONTAINS MAT"] and [n[:12] for n in rows[3].notes] == ["CONTAINS MAT"]
    assert rows[2].warnings == ["TEXT ORDER MAY NOT MATCH THE VISUAL LAYOUT (try --sort)"]
    assert not plan.process(df, PageOptions(sort=True)).where("page_no = 2").first().warnings
    assert plan.select_pages(df, [2]).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    (tmp_path / "b.pdf").write_bytes(b"junk%PDF-1.7 broken")
    rows = {r.doc_id[-5:]: r.file_error for r in pdf.decode(pdf.read_files(spark, str(tmp_path / "*.pdf"))).collect()}
    assert "no %PDF header" in rows["a.pdf"]
    assert rows["b.pdf"].startswith(("PyMuPDF is required", "Could not open"))
    sinks.write_text(tmp_path / "x.txt", "a\nb")
    assert (tmp_path / "x.txt").read_bytes() == b"a\nb" and not (tmp_path / "x.txt.tmp").exists()
    with pytest.raises(InputError, match="Could not write"):
        sinks.write_text(tmp_path / "no" / "x.txt", "a")
    images = spark.createDataFrame([("/d/m.pdf", 2, "page_002.png")], "doc_id string, page_no int, image_name string")
    sinks.save_images(images, lambda d, n: f"{d}{n}".encode(), str(tmp_path))
    assert (tmp_path / "m_problem_pages" / "page_002.png").read_bytes() == b"/d/m.pdf2"


@pytest.mark.parametrize("name", ["problem_image_names", "ocr_summaries", "ocr_page_render"])
def test_texts_are_measured_once(spark, name):
    """Spark must not copy the expressions over a page's text into the filters and columns that name their results."""
    found = getattr(outputs, name)(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sides = 1 if name == "problem_image_names" else 2  # the pages, and those that OCR is run on
    assert 0 < plan.count("p{L}") <= sides


def test_recognised_texts_move_no_page(spark):
    """What the pages hold already is joined with nothing, and gives what a join gives."""
    sf = "/root/testdata/sf0.001"
    found = outputs.ocr_page_render(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p{L}") == 1 and "Join" not in plan
    decided = pages.decide(queries.measured(spark, sf))
    seen = decided.withColumn("seen", outputs.recognised()).where("seen is not null").select("doc_id", "page_no", "seen.*")
    columns = ("doc_id", "page_no", *(c for c in pages.RESULT if c not in ("doc_id", "page_no")))
    ways = (pages.assemble(decided, of, ocr=True).select(*columns).orderBy("doc_id", "page_no").collect() for of in (outputs.recognised(), seen))
    assert next(ways) == next(ways) != []


def test_documents_of_any_size_are_read(spark):
    """No file is taken whole into a row, which holds 2 GB at most; here, 100 bytes."""
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "100")
    try:
        assert min(r.n for r in outputs.page_documents(spark, "/root/testdata/sf0.001").collect()) > 100
    finally:
        spark.conf.unset(key)


def test_rasters_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    assert queries.ink_ratios(spark, "/root/testdata/sf0.001").count() == 200
    assert int(spark.conf.get(key)) <= layout.RASTERS
    spark.conf.set(key, before)
