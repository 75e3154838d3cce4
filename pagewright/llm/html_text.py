"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and a threshold.

The standard library's parser streams a page's tags and texts.  Block elements end a line.  Each line has a
text-to-tag ratio: its characters over the tags it holds, links counting double.  Furniture has the ratio 0: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden elements.  The ratios are
smoothed along the page by a Gaussian, and the mean of the two clusters that they fall into is the threshold.  Lines that
are above it, smoothed and nearly so by themselves, are the core of the content.

The core chooses the content.  Where articles hold two thirds of its lines, all lines of the articles with core lines
are the content, however short, with the page's headline if it stands before them; else, where a main element does,
all its lines.  In other pages it is all from the first core line to the last, and the headings, paragraphs and list
items next to them, as far as they follow each other in the innermost element around the core, or directly in those
around it.

Defined cases: null, empty and text-free pages give the empty text; unclosed and stray tags are taken as browsers take
them, and malformed declarations as comments; a tag that the page ends in has no text; equal pages give equal rows;
long pages are read whole; an empty table gives an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDER = frozenset("article aside blockquote button canvas center details dialog div dl fieldset figure footer form head header iframe main menu nav noscript object ol option search section select svg table template textarea ul math".split())
FURNITURE = frozenset("aside button canvas dialog fieldset footer form head iframe menu nav noscript object option script search select style svg template textarea".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement adsense advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: What a class name within an article may hold besides: there only names made of hints and these are furniture.
PLAIN = frozenset("area article articles bar block body bottom box button buttons center container content form foot global group head heading inner item items left link links list main module outer page panel post posts primary right section side site slot social story tools top unit wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements whose lines read as text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th summary".split())
LISTS = frozenset("ul ol dl blockquote figure table details".split())
SIGMA = 1.5
#: Less than any line with text has, but for furniture, which has 0.
LEAST = 1e-9
#: A line with links on so much of its text is a list of links.
LINKED = 0.6
SCHEMA_TAIL = "text string"


class Line:
    __slots__ = ("linked", "out", "parts", "region", "tag", "tags")

    def __init__(self, out: bool, region: int, tag: str) -> None:
        self.parts: list[str] = []
        self.tags, self.linked, self.out, self.region, self.tag = 0, 0, out, region, tag


class Lines(HTMLParser):
    """The lines of a page, with their tags, their region (the innermost element around them) and whether they are furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.opened: Counter[str] = Counter()
        #: Element and parent of each region.
        self.regions: list[tuple[str, int]] = [("body", -1)]
        self.lines = [Line(False, 0, "body")]
        self.linking = False
        self.articles = 0

    def state(self) -> tuple[str, bool, int]:
        return self.open[-1] if self.open else ("body", False, 0)

    def end_line(self, tag: str | None = None, hint: bool = False) -> None:
        around, out, region = self.state()
        last = self.lines[-1]
        if last.parts or last.tags:
            self.lines.append(Line(out or hint, region, tag or around))
        else:
            last.out, last.region, last.tag = out or hint, region, tag or around

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        hinted = bool(attrs) and self.is_furniture(tag, attrs, self.articles > 0)
        if tag in HOLDER:
            _, out, region = self.state()
            page_header = tag == "header" and not self.articles
            self.regions.append((tag, region))
            self.open.append((tag, out or hinted or tag in FURNITURE or page_header, len(self.regions) - 1))
            self.opened[tag] += 1
            self.articles += tag == "article"
        if tag in BLOCK or tag in HOLDER:
            self.linking = False
            self.end_line(tag, hinted and tag not in HOLDER)
        elif tag == "br":
            self.lines[-1].parts.append(" ")
        elif tag == "a":
            self.linking = True
        self.lines[-1].tags += 2 if tag == "a" else 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.opened[tag]:  # what is open inside ends too
            ended = self.open.pop()[0]
            self.opened[ended] -= 1
            self.articles -= ended == "article"
            if ended == tag:
                break
        if tag == "a":
            self.linking = False
        if tag in BLOCK or tag in HOLDER:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.cdata_elem is None:
            line = self.lines[-1]
            line.parts.append(data)
            line.linked += len(data.strip()) * self.linking

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    @staticmethod
    def is_furniture(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if name == "role" and value.strip() in ROLES:
                return True
            if name in ("class", "id"):
                for word in value.split():
                    parts = set(re.findall("[a-z]+", word))
                    if parts & HINTS and (not within or parts <= HINTS | PLAIN):
                        return True
        return False


def lines_of(html: str) -> Lines:
    """The parsed page.  What follows the last tag's end holds no tag that browsers would show anything of."""
    end = html.rfind(">") + 1
    parser = Lines()
    parser.feed(html[:end])
    parser.feed(re.split("<[A-Za-z!/?]", html[end:], maxsplit=1)[0])
    parser.close()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the first and last values go on."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def two_means(values: np.ndarray) -> float:
    """The middle between the means of the two clusters of values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all():
            return middle
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def chosen(parser: Lines, lines: list[tuple[str, Line]], threshold: float | None = None) -> list[int]:
    """The numbers of the lines that are content.  With a threshold given, a page may have none."""
    own = np.array([0.0 if x.out else len(t) / max(1, x.tags) for t, x in lines])
    ratios = smoothed(own)
    fixed = threshold is not None
    if not fixed:
        threshold = two_means(ratios)
    linked = [x.linked >= LINKED * len(t) for t, x in lines]
    usable = [i for i in range(len(lines)) if own[i] >= min(threshold, LEAST)]
    dense = [i for i in usable if ratios[i] >= threshold and own[i] >= threshold / 2]
    core = dense if fixed else [i for i in dense if not linked[i]] or usable
    if not core:
        return []
    # lines of the core by region, with those inside
    held = [0] * len(parser.regions)
    for i in core:
        held[lines[i][1].region] += 1
    for region in range(len(held) - 1, 0, -1):
        held[parser.regions[region][1]] += held[region]
    # for each region, the outermost article and main element around it; parents come first
    around = {"article": [-1] * len(held), "main": [-1] * len(held)}
    for kind, outer in around.items():
        for region, (tag, parent) in enumerate(parser.regions):
            outer[region] = outer[parent] if parent >= 0 and outer[parent] >= 0 else region if tag == kind else -1
    for kind, outer in around.items():
        if 3 * sum(held[r] for r in set(outer) - {-1}) >= 2 * held[0]:
            wanted = {outer[lines[i][1].region] for i in core} - {-1}
            inside = [i for i in usable if outer[lines[i][1].region] in wanted]
            if not any(lines[i][1].tag == "h1" for i in inside):
                inside = [i for i in usable if i < inside[0] and lines[i][1].tag == "h1"][-1:] + inside
            return inside
    # the innermost region that holds nearly all of the core, and those around it
    region, within = 0, [0] * len(held)
    for r, (_, parent) in enumerate(parser.regions):
        if parent == region and held[r] >= 0.9 * held[0]:
            region = r
    path, r = set(), region
    while r >= 0:
        path.add(r)
        r = parser.regions[r][1]
    for r, (tag, parent) in enumerate(parser.regions):
        # a box beside bare paragraphs is another thing; a list among them isn't
        within[r] = r == region or parent >= 0 and within[parent] and (region > 0 or tag in LISTS)
    inside = [i for i in usable if core[0] <= i <= core[-1]]
    joins = lambda i: own[i] >= LEAST and not linked[i] and lines[i][1].tag in TEXTUAL and (within[lines[i][1].region] or lines[i][1].region in path)
    low, high = core[0], core[-1]
    while low > 0 and joins(low - 1):
        low -= 1
    while high + 1 < len(lines) and joins(high + 1):
        high += 1
    return [*range(low, core[0]), *inside, *range(core[-1] + 1, high + 1)]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in order, one a line."""
    if not html:
        return ""
    parser = lines_of(html)
    lines = [(" ".join("".join(x.parts).split()), x) for x in parser.lines]
    lines = [(t, x) for t, x in lines if t]
    if all(x.out for _, x in lines):
        return ""
    return "\n".join(lines[i][0] for i in chosen(parser, lines))


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, the main text and its number of code points."""
    prepare(pages.sparkSession)
    source = pages.select(*keep, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), SCHEMA_TAIL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, "text"])

    return source.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
