"""Text functions as Spark columns.

White space means what Python's ``str.isspace`` means; Java's own class is narrower.  What Spark lacks (exact half-even
formatting) is an Arrow UDF and named ``*_udf``; ``markup`` and ``folding`` hold what takes tables.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..config import MATH_SIGNS, PREVIEW

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda, Spark works out everything else anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The rows with these columns, worked out once a row.

    They come from a generator, as Spark would copy the expressions of a projection into each filter and column that names them.
    """
    return rows.select(*(c for c in rows.columns if c not in made), F.inline(F.array(F.struct(*(v.alias(k) for k, v in made.items())))))


def table_text(entries: dict[str, str]) -> str:
    """A small table as one text, for ``looked_up``: a literal of Spark's, where a map of columns is planned entry by entry."""
    return "".join(f"\0{k}\1{v}" for k, v in entries.items()) + "\0"


def looked_up(table: Column, key: Column) -> Column:
    """The value of a key in a table's text; null if there is none."""
    at = F.instr(table, F.concat(F.lit("\0"), key, F.lit("\1")))
    return F.when(at > 0, F.substring_index(F.substr(table, at + F.length(key) + 2), "\0", 1))


#: The same; most characters of a text are ruled out by the first look.
RARE_SPACE = rf"[\x00-\x20\x7f-\x{{10ffff}}&&{SPACE}]"


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{RARE_SPACE}+", "")


def count_chars(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(without_space(text))


def char_ranges(chars: str) -> str:
    """Characters as ranges of a pattern's class, which Java tries one after the other."""
    points = sorted(set(map(ord, chars)))
    starts, ends = (p for p in points if p - 1 not in points), (p for p in points if p + 1 not in points)
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


#: What is no mathematical sign: most characters are outside of all the signs' range, which is looked at first.
NO_SIGN = rf"[[^{min(MATH_SIGNS)}-{max(MATH_SIGNS)}][^{char_ranges(MATH_SIGNS)}]]+"


def count_math(text: Column) -> Column:
    """Mathematical signs."""
    return F.length(F.regexp_replace(text, NO_SIGN, ""))


#: What is no garbage, and what is no letter or number: by runs, as each match costs Spark a piece of text.
GARBAGE, ALNUM = r"[[\x20-\x7e][^\x{FFFD}\p{Co}\p{Cc}\p{Cs}]]+", r"[^\p{L}\p{N}]+"


def share_of(solid: Column, unwanted: str, empty: float) -> Column:
    """Share, among the characters of a text without white space, of those that a pattern does not remove."""
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, unwanted, "")) / F.length(solid)).otherwise(F.lit(empty))


def garbage_ratio(text: Column) -> Column:
    """Share of replacement, private-use, control and surrogate characters; 0 without text."""
    return let(without_space(text), lambda solid: share_of(solid, GARBAGE, 0.0))


def alnum_ratio(text: Column) -> Column:
    """Share of letters and numbers; 1 without text."""
    return let(without_space(text), lambda solid: share_of(solid, ALNUM, 1.0))


def solid_metrics(text: Column) -> Column:
    """A struct of chars, garbage_ratio and alnum_ratio, from one look for white space."""
    return let(without_space(text), lambda solid: F.struct(F.length(solid).alias("chars"), share_of(solid, GARBAGE, 0.0).alias("garbage_ratio"), share_of(solid, ALNUM, 1.0).alias("alnum_ratio")))


def clean_text(text: Column) -> Column:
    """Line ends made alike, control characters and blanks at line ends dropped, at most two empty lines in a row."""
    blank = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
    for pattern, new in (
        (r"\r\n|\r", "\n"),
        (r"[\p{Cc}&&[^\n\t]]", ""),
        (rf"(?<!{blank}){blank}++(?=\n|\z)", ""),
        (r"\n{4,}", "\n\n\n"),
        (r"\A\n+|\n+\z", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def visible(value: str) -> str:
    """What a reader sees of an HTML fragment: tags go first, then entities are decoded."""
    shown = html.unescape(re.sub("<[^>]*>", "", value))
    return " ".join(shown.split())


def preview(text: Column, limit: int = PREVIEW) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def line_breaks(text: Column) -> Column:
    """Line ends as HTML line breaks."""
    return F.regexp_replace(text, "\r\n|\r|\n", "<br>")


def tsv_field(text: Column) -> Column:
    """A field of a tab-separated file: one line, in quotes if it has a tab or a quote or starts with a number sign."""
    line = line_breaks(text)
    return F.when(line.rlike('[\t"]|^#'), F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(line)


def stable_id(text: Column) -> Column:
    """A number from 2**30 to 2**31 that depends on the text alone."""
    return F.lit(1 << 30) + F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % F.lit(1 << 30)


def percent(share: Column) -> Column:
    """A whole percentage; ties go to the even number."""
    return F.concat(F.rint(share * 100).cast("long").cast("string"), F.lit("%"))


def stem(path: Column) -> Column:
    """File name without its folder and its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def deck_title(path: Column) -> Column:
    return F.replace(stem(path), F.lit("_"), F.lit(" "))


def zero_padded(number: Column, most: Column) -> Column:
    """At least three digits, as many as the largest number has, and never fewer than the number's own."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(3), F.length(most.cast("string")), F.length(digits)), F.lit("0"))


@pandas_udf(T.StringType())
def fixed_udf(values: pd.Series, digits: pd.Series) -> pd.Series:
    """A number with so many digits after the point, from its exact value."""
    return pd.Series([None if v != v else f"{v:.{int(d)}f}" for v, d in zip(values.astype(float), digits, strict=True)])


def tags_of(tags: Column) -> Column:
    """A text's words: the tags of an export; none of a null."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), f"{SPACE}+"), lambda t: t != "")


def split_tags(tags: str | None) -> list[str]:
    return (tags or "").split()
