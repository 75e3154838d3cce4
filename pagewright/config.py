"""Thresholds, word lists and formats that results depend on (fixed values), and the options of a run."""

from __future__ import annotations

from dataclasses import dataclass

# -- pages
OCR_THRESHOLD = 50
OCR_DPI, IMAGE_DPI, ANALYSIS_DPI = 300, 150, 36
INK_DELTA = 48
BLANK_INK = 0.001
NONTEXT_INK = 0.02
WEAK_TEXT_COVERAGE = 0.10
GARBAGE = 0.10
LEAST_ALNUM, ALNUM_FROM_CHARS = 0.15, 20
SUPPLEMENT_COVERAGE = 0.40
COMPLEX_COVERAGE, COMPLEX_IMAGES, COMPLEX_DRAWINGS = 0.30, 3, 50
SIGNIFICANT_IMAGE = 0.02
FRAGMENTS, FRAGMENT_CHARS = 12, 25
LOW_CONFIDENCE = 60.0
COLUMN_CHARS, COLUMN_MARGIN = 40, 0.05
JUMP_UP, JUMP_LEFT = 24.0, 10.0
JUMPS_LEAST, JUMPS_SHARE = 2, 0.25
BOX_PADDING = 3.0
MATH_FONTS = "CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|Math|STIX|MTExtra|Euclid|esint|rsfs"
MATH_SIGNS = "∑∏∫∮√∞≈≠≤≥±∓×÷∂∇∈∉⊂⊆∪∩∀∃→⇒⇔↔αβγδεθλμπρστφχψωΓΔΘΛΠΣΦΨΩ"
MATH_LEAST = 3
# -- decks
LETTERS = ("A", "B", "C", "D")
REQUIRED = ("question", "answer", "options")
OPTIONAL = ("explanation",)
EXPORT_COLUMNS = ("Question", "OptionA", "OptionB", "OptionC", "OptionD", "CorrectAnswer", "CorrectLetter", "Explanation")
NOTE_TYPE = "Multiple Choice (A-D)"
PLACEHOLDERS = ("...", "…", "todo", "tbd", "n/a", "placeholder", "question", "answer", "?", "-")
HTML_TAGS = frozenset(
    "a abbr b big blockquote br center cite code dd del dfn div dl dt em font h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp small span strike strong sub sup table tbody td tfoot th thead tr tt u ul var anki-mathjax".split()
)
OPTION_LABEL = r"^\s*(?:\(?[A-Da-d]\)|[A-Da-d][.:)])\s+"
CHI2_LEAST, CHI2_ALPHA = 8, 0.01
#: The chi-square value of three degrees of freedom at CHI2_ALPHA.
CHI2_CRITICAL = 11.344866730144373
PREVIEW, PREVIEW_LINE, PREVIEW_SNIPPET, PREVIEW_SOURCE = 70, 100, 30, 160


@dataclass(frozen=True)
class PageOptions:
    """How pages are processed; the names are those of the command line."""

    ocr: bool = False
    ocr_threshold: int = OCR_THRESHOLD
    ocr_lang: str = "eng"
    ocr_dpi: int = OCR_DPI
    image_dpi: int = IMAGE_DPI
    sort: bool = False
    password: str | None = None
    pages: str | None = None


class InputError(Exception):
    """A problem of the input or the options, shown to the user without a traceback."""
