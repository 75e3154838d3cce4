"""Secret scanning: fixed patterns, and Shannon entropy in a sliding window.

Base kinds are what the patterns of assignments, access keys and hexadecimal runs match.  The method adds ``entropy``
spans: each candidate string of key characters is walked by a window of fixed width for its character class; the
window's entropy is kept up by adding the term of the entering character and taking off that of the leaving one, and
a candidate whose windows reach the class's threshold is reported from the first such window to the last.  Strings
on the allow list, which covers well-known harmless shapes, are passed over, and so are those that a base span covers.

Defined cases: a null text is empty and has no spans; all places are code points with exclusive ends; spans are in
order of start, then of kind as listed in KINDS; long texts are read whole, in time in proportion to their length;
repeated rows, and rows without id, are rows of their own; an empty table gives an empty result; other columns of the
table are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Characters of a window: no candidate is shorter.
WINDOW = 20
#: Per character class: what belongs to it, the window, and the bits a character that count as random, which 99 of 100
#: random strings of one window reach.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), WINDOW, 2.5),
    ("hex", re.compile(r"[0-9A-Fa-f]+"), WINDOW, 2.9),
    ("letters", re.compile(r"[a-z]+|[A-Z]+"), WINDOW, 3.2),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), WINDOW, 3.38),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), WINDOW, 3.58),
)
#: Harmless: UUIDs and placeholders.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r".*(example|placeholder|changeme|xxxx|0123456789|abcdefgh).*", re.IGNORECASE),
)
#: Harmless if their letters look like words: file paths, words joined by marks, and words in one or camel case.
WORDED = (
    re.compile(r"[/-]?([A-Za-z]+|[0-9]{1,4})([/_-]([A-Za-z]+|[0-9]{1,4}))*[/-]?"),
    re.compile(r"[A-Z]?[a-z]+([A-Z][a-z]{2,})*[0-9]{0,4}"),
)
#: Parts of camel case, and what no word has: a run of six consonants.
PARTS, CLUSTER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[b-df-hj-np-tv-xz]{6}")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def entropy_spans(text: str, width: int, threshold: float) -> list[tuple[int, int]]:
    """Maximal runs of windows of ``width`` characters whose entropy is at least ``threshold`` bits."""
    if len(text) < width:
        return []
    terms = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    whole = math.log2(width)
    for i, entering in enumerate(text):
        n = counts.get(entering, 0)
        total += terms[n + 1] - terms[n]
        counts[entering] = n + 1
        if i >= width:
            leaving = text[i - width]
            n = counts[leaving]
            total += terms[n - 1] - terms[n]
            counts[leaving] = n - 1
        if i >= width - 1 and whole - total / width >= threshold - 1e-9:
            low = i - width + 1
            if spans and low <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((low, i + 1))
    return spans


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOWED) or any(p.fullmatch(text) for p in WORDED) and like_words(text)


def like_words(text: str) -> bool:
    """Letters in parts of more than three on average, a quarter of them vowels, without six consonants in a row."""
    parts, low = PARTS.findall(text), text.lower()
    letters = sum(map(len, parts))
    return letters > 3.2 * len(parts) and 4 * sum(map(low.count, "aeiouy")) >= letters and not CLUSTER.search(low) or not parts


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each span of a text."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))

    def covered(low: int, high: int) -> bool:
        before = bisect_right(starts, low)
        return before > 0 and reach[before - 1] >= high

    for m in CANDIDATE.finditer(text):
        if covered(m.start(), m.end()) or allowed(m[0]):
            continue
        _, _, width, threshold = next(c for c in CLASSES if c[1].fullmatch(m[0]))
        spans = ((low + m.start(), high + m.start()) for low, high in entropy_spans(m[0], width, threshold))
        found += [("entropy", low, high) for low, high in spans if not covered(low, high)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x.as_py())] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def secret_spans(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every span of every document, in order."""
    prepare(documents.sparkSession)
    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_scan, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "entropy").encode()).hexdigest()
