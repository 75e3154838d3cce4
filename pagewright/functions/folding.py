"""Case folding as a column: every character by the full folding of Unicode, whatever stands beside it.

The table is made by Python's own folding, so both sides agree on the version of Unicode.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, looked_up, table_text


@cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, these others in the same order, and those that fold to several."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        if (folded := c.casefold()) != c:
            (one if len(folded) == 1 else more)[c] = folded
    return "".join(one), "".join(one.values()), more


def class_of(signs: str) -> str:
    """A regular expression for one of these characters, by ranges, as Java tries the members of a class in turn."""
    ranges: list[list[int]] = []
    for n in sorted(map(ord, signs)):
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in ranges)}]"


def folded(text: Column) -> Column:
    """The text in the form that is alike for upper and lower case."""
    old, new, more = foldings()
    pattern = class_of("".join(more))

    def spelt(t: Column) -> Column:
        several = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda c: looked_up(F.lit(table_text(more)), c)), F.array(F.lit("")))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(F.split(t, pattern, -1), several, lambda a, b: F.concat(a, b)), "")).otherwise(t)

    return F.translate(let(text, spelt), old, new)
