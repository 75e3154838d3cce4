"""Page ranges: parsing a selection, and writing a list of pages as ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import InputError

PART = re.compile(r"([0-9]+)(-([0-9]*))?")


def parse_page_range(spec: str, count: int) -> list[int]:
    """Sorted page numbers of a selection such as ``1-5,8,10-``."""
    chosen: set[int] = set()
    for part in filter(None, spec.replace(" ", "").split(",")):
        if not (m := PART.fullmatch(part)):
            raise InputError(f"Invalid page range {part!r}. Use forms like 1-10, 1,3,5 or 1-5,8,10-12.")
        low = int(m[1])
        high = low if m[2] is None else int(m[3] or count)
        if not 1 <= low <= high:
            raise InputError(f"Invalid page range {part!r}.")
        if high > count:
            raise InputError(f"Page range {part!r} goes past the end of the document ({count} pages).")
        chosen |= {*range(low, high + 1)}
    if not chosen:
        raise InputError(f"No pages selected by --pages {spec!r}.")
    return sorted(chosen)


def page_list(pages: Column) -> Column:
    """An array of page numbers as text: ``1-3, 7, 9-10``.  Each number is compared with its neighbours only."""
    ordered = F.array_sort(F.array_distinct(pages))
    before = F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda x: x.cast("long")))
    stepped = F.zip_with(ordered, before, lambda x, y: F.struct(x.cast("long").alias("x"), y.alias("before")))
    starts = F.filter(stepped, lambda s: s["before"].isNull() | (s["before"] + 1 < s["x"]))
    # a run ends where the next one starts, or with the last number
    ends = F.concat(F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda s: s["before"]), F.slice(F.transform(ordered, lambda x: x.cast("long")), F.greatest(F.size(ordered), F.lit(1)), F.lit(1)))
    return F.array_join(F.zip_with(starts, ends, lambda s, e: F.when(s["x"] == e, e.cast("string")).otherwise(F.concat_ws("-", s["x"].cast("string"), e.cast("string")))), ", ")


def page_ranges(pages: DataFrame, group: list[str], page: str) -> DataFrame:
    """The same for rows: one text (``ranges``) for each group, by islands of consecutive numbers."""
    order = Window.partitionBy(*group).orderBy(page)
    islands = pages.select(*group, page).distinct().withColumn("_island", F.col(page) - F.row_number().over(order))
    spans = islands.groupBy(*group, "_island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    written = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    texts = spans.select(*group, F.struct(F.col("a"), written.alias("t")).alias("s"))
    return texts.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), ", ").alias("ranges"))


WORD = 64


def page_sets(pages: DataFrame, kinds: dict[str, Column], *, group: str = "doc_id", page: str = "page_no") -> DataFrame:
    """(group, a struct for each kind): n, how many different pages it has, and ranges, these as text.

    Page numbers (from 0 on) become bits of 64-bit words, which are merged before the shuffle: a row a word, not a page.  A
    run of pages starts at a bit whose neighbour below is not set, and ends at one whose neighbour above isn't; the
    neighbours of a word's outer bits are in the words beside it.  So each word gives its own part of the text, and these
    follow each other.
    """
    number, word = F.col(page).cast("long"), F.col("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD).cast("int"))
    words = pages.groupBy(group, F.floor(number / WORD).alias("_word")).agg(*(F.coalesce(F.bit_or(F.when(condition, bit)), F.lit(0).cast("long")).alias(k) for k, condition in kinds.items()))
    order = Window.partitionBy(group).orderBy("_word")
    beside = lambda f, step, k: F.when(f("_word").over(order) == word + step, f(k).over(order)).otherwise(F.lit(0).cast("long"))
    held = words.select(group, "_word", *kinds, *(beside(F.lag, -1, k).alias(f"_b_{k}") for k in kinds), *(beside(F.lead, 1, k).alias(f"_a_{k}") for k in kinds))

    def text(k: str) -> Column:
        """What the word adds: a comma and a number for each start, a dash and a number for each end that is not its start."""
        x, carry = F.col(k), F.shiftrightunsigned(F.col(f"_b_{k}"), WORD - 1)
        above = F.shiftleft(F.col(f"_a_{k}").bitwiseAND(F.lit(1).cast("long")), WORD - 1)
        starts = x.bitwiseAND(F.bitwise_not(F.shiftleft(x, 1).bitwiseOR(carry)))
        ends = x.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(x, 1).bitwiseOR(above)))
        has = lambda bits, i: F.call_function("shiftrightunsigned", bits, i).bitwiseAND(F.lit(1).cast("long")) == 1
        shown = lambda i: (word * WORD + i).cast("string")
        at = lambda i: F.when(has(starts, i), F.concat(F.lit(", "), shown(i))).when(has(ends, i), F.concat(F.lit("-"), shown(i)))
        return F.when(starts.bitwiseOR(ends) == 0, F.lit("")).otherwise(F.array_join(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), at)), ""))

    parts = held.select(group, "_word", *(F.bit_count(F.col(k)).cast("long").alias(f"_n_{k}") for k in kinds), *(text(k).alias(k) for k in kinds))
    joined = lambda k: F.expr(f"substr(listagg(`{k}`, '') WITHIN GROUP (ORDER BY _word), 3)")
    return parts.groupBy(group).agg(*(F.struct(F.sum(f"_n_{k}").alias("n"), F.coalesce(joined(k), F.lit("")).alias("ranges")).alias(k) for k in kinds))
