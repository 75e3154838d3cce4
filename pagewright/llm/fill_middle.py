"""Fill-in-the-middle rearrangement of documents, in Spark SQL functions only.

A text is matched from left to right into units (lines with their line feeds, by default).  Two cuts between units and
the arrangement come from the SHA-256 of a seed and the id, so they depend on neither partitions nor other rows:

* ``psm``: prefix mark, prefix, suffix mark, suffix, middle mark, middle;
* ``spm``: suffix mark, suffix, prefix mark, prefix, middle mark, middle;
* ``plain``: the text as it is, if it is empty, holds a mark itself, or is left out by the rate.

``restored`` reads an output's marks and puts the parts back in order.  As no part holds a mark, and no mark starts with
the end of another, the marks found are those that were written.

Every row is made by itself: no shuffle, no Python.

Defined cases: a null text is an empty one; a null id is hashed as an empty string; rows that repeat an id are cut by the
same numbers, each by its own count of units; long texts are read whole; an empty table gives an empty result; form, n,
output, prefix_chars and middle_chars are put in place of columns of these names, and other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Marks:
    """The strings that stand before the parts; none may overlap with another or with itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        if len(set(every)) < 3 or any(b.startswith(a[i:]) for a in every for b in every for i in range(len(a)) if i or a != b):
            raise ValueError(f"marks overlap: {every}")

    @property
    def pattern(self) -> str:
        return "|".join(map(re.escape, (self.prefix, self.suffix, self.middle)))


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def joined(units: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(units, start + 1, stop - start), "")


def rearranged(documents: DataFrame, *, key: str = "doc_id", text: str = "text", units: str = LINES, seed: str = "7", rate: int = 100, spm_rate: int = 50, marks: Marks | None = None) -> DataFrame:
    """The documents with form, n (units), output, prefix_chars and middle_chars.

    ``rate`` of 100 texts are rearranged, and ``spm_rate`` of 100 of these with the suffix first.
    """
    marks = marks or Marks()
    whole, parts, first, second, kind, a, b, c = unused(documents, *(f"__{x}" for x in ("whole", "parts", "first", "second", "kind", "prefix", "middle", "suffix")))
    made = ("form", "n", "output", "prefix_chars", "middle_chars")
    others = [x for x in documents.columns if x.lower() not in made]
    h1, h2, h3, h4 = draws(F.col(key), seed)
    cut = documents.withColumns({whole: text_of(text), parts: F.regexp_extract_all(text_of(text), F.lit(units), F.lit(0))})
    n = F.size(parts)
    plain = (F.col(whole) == "") | F.col(whole).rlike(marks.pattern) | (h3 % 100 >= rate)
    cut = cut.withColumns({first: (h1 % (n + 1)).cast("int"), second: (h2 % (n + 1)).cast("int"), kind: F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")})
    low, high = F.least(first, second), F.greatest(first, second)
    split = cut.withColumns({a: joined(F.col(parts), F.lit(0), low), b: joined(F.col(parts), low, high), c: joined(F.col(parts), high, n)})
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = F.when(F.col(kind) == "plain", F.col(whole)).when(F.col(kind) == "psm", F.concat(p, a, s, c, m, b)).otherwise(F.concat(s, c, p, a, m, b))
    chars = lambda part: F.when(F.col(kind) != "plain", F.length(part).cast("long"))
    return split.select(*others, F.col(kind).alias("form"), n.cast("long").alias("n"), output.alias("output"), chars(a).alias("prefix_chars"), chars(b).alias("middle_chars"))


def restored(output: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, (marks or Marks()).pattern, -1)  # what stands before the first mark is empty
    at = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def report(made: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH unit AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM unit
), cut AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), part AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM part
), parsed AS (SELECT *, regexp_split_to_array(o, '<[PSM]>') AS x FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM parsed
"""
