"""Reading PDF files as rows of pages.  Decoding needs PyMuPDF, which is optional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANALYSIS_DPI, InputError
from ..functions.ranges import parse_page_range
from .rows import map_rows

BLOCK = "struct<seq:int,x0:double,y0:double,x1:double,y1:double,text:string,type:int>"
PAGES = (
    f"doc_id string, page_no int, page_count int, blocks array<{BLOCK}>, images array<struct<x0:double,y0:double,x1:double,y1:double>>, fonts array<string>, "
    "drawing_count int, table_count int, x0 double, y0 double, width double, height double, raster struct<w:int,h:int,stride:int,samples:binary>, error string, file_error string"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, file_error): the files and what can be said against them before decoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), "content", header_error(F.col("path"), F.col("content")).alias("file_error"))


def header_error(path: Column, content: Column) -> Column:
    """A PDF names itself within its first 1024 bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    return F.when(~F.contains(head, F.lit(b"%PDF-".hex().upper())), F.concat(path, F.lit(" does not look like a PDF file (no %PDF header).")))


def decode(files: DataFrame, *, pages: str | None = None, password: str | None = None) -> DataFrame:
    """A row a page; files that can't be read give one row with ``file_error``.

    The selection is applied before a page is touched, as Spark can't push it into Python code.
    """

    def rows(doc_id: str, content: bytes, error: str | None) -> list[dict]:
        if error is None:
            try:
                return decoded(doc_id, content, pages, password)
            except InputError as e:
                error = str(e)
        return [{"doc_id": doc_id, "page_count": 0, "file_error": error}]

    return map_rows(files.select("doc_id", "content", "file_error"), rows, PAGES)


def decoded(doc_id: str, content: bytes, selection: str | None, password: str | None) -> list[dict]:
    """The selected pages of one file."""
    try:
        import pymupdf
    except ImportError:
        raise InputError("PyMuPDF is required. Install it with:\n    pip install pymupdf") from None
    try:
        document = pymupdf.open(stream=content, filetype="pdf")
    except Exception as error:  # noqa: BLE001  whatever the decoder raises
        raise InputError(f"Could not open {doc_id} - the PDF appears to be corrupted ({error}).") from None
    if document.needs_pass:
        if not password:
            raise InputError(f"{doc_id} is password-protected. Supply the password with --password.")
        if not document.authenticate(password):
            raise InputError("The password given with --password is not correct for this PDF.")
    if not document.page_count:
        raise InputError(f"{doc_id} contains no pages (the file may be damaged).")
    numbers = parse_page_range(selection, document.page_count) if selection else range(1, document.page_count + 1)
    return [{"doc_id": doc_id, "page_no": n, "page_count": document.page_count, **page_row(pymupdf, document, n)} for n in numbers]


def page_row(pymupdf, document, number: int) -> dict:
    """What is read from a page; a damaged page gives an error, not an exception."""
    try:
        page = document[number - 1]
        box = page.rect
        flags = pymupdf.TEXT_PRESERVE_WHITESPACE | pymupdf.TEXT_MEDIABOX_CLIP
        grey = page.get_pixmap(matrix=pymupdf.Matrix(ANALYSIS_DPI / 72, ANALYSIS_DPI / 72), colorspace=pymupdf.csGRAY, alpha=False)
        fields = ("x0", "y0", "x1", "y1")
        return {
            "blocks": [{"seq": i, **dict(zip(fields, b[:4], strict=True)), "text": b[4], "type": b[6]} for i, b in enumerate(page.get_text("blocks", flags=flags, sort=False))],
            "images": [dict(zip(fields, x["bbox"], strict=True)) for x in page.get_image_info()], "fonts": [str(f[3]) for f in page.get_fonts()],
            "drawing_count": counted(page.get_drawings), "table_count": counted(lambda: page.find_tables().tables),
            "x0": box.x0, "y0": box.y0, "width": box.width, "height": box.height, "raster": {"w": grey.width, "h": grey.height, "stride": grey.stride, "samples": bytes(grey.samples)},
        }
    except Exception as error:  # noqa: BLE001
        return {"error": f"{type(error).__name__}: {error}"}


def counted(probe) -> int:
    try:
        return len(probe())
    except Exception:  # noqa: BLE001
        return 0


def opened(content: bytes, password: str | None = None):
    """An open document; PyMuPDF closes it with the last reference."""
    import pymupdf

    document = pymupdf.open(stream=content, filetype="pdf")
    if document.needs_pass:
        document.authenticate(password or "")
    return document


def image_of(document, number: int, dpi: int) -> bytes:
    """A page of an open document as PNG."""
    import pymupdf

    return document[number - 1].get_pixmap(matrix=pymupdf.Matrix(dpi / 72, dpi / 72), alpha=False).tobytes("png")


def rendered(content: bytes, number: int, dpi: int, password: str | None = None) -> bytes:
    """A page as PNG."""
    return image_of(opened(content, password), number, dpi)
