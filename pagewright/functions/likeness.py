"""Likeness of short names as columns: twice the characters in common blocks, by the length of both (Ratcliff and Obershelp)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Least likeness of a name that is meant (fixed value).
MEANT = 0.6
RANGES = "array<struct<a0:int,a1:int,b0:int,b1:int>>"


def pieces(word: Column) -> Column:
    """All parts (start, size, text) of a word, the longest first and those of a size from left to right."""
    n = F.length(word)
    part = lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("i"), k.alias("k"), F.substr(word, i + 1, k).alias("s")))
    return F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), part))


def common(word: Column, parts: Column, text: Column) -> Column:
    """Characters in common blocks: the longest common block, the first in the word and then in the text, and so on on either side of it.

    Ranges that are still to be looked at wait in a list.  Each look ends a range or finds a block of a character at least,
    so twice the word's length and one are enough.  ``parts`` are the word's pieces, at least those that the text has.
    """

    def look(held: Column, _: Column) -> Column:
        last = F.get(held["todo"], F.size(held["todo"]) - 1)
        inside = lambda r: F.substr(text, r["b0"] + 1, r["b1"] - r["b0"])
        fits = lambda r: F.filter(parts, lambda p: (p["i"] >= r["a0"]) & (p["i"] + p["k"] <= r["a1"]) & F.contains(inside(r), p["s"]))
        rest = F.slice(held["todo"], F.lit(1), F.size(held["todo"]) - 1)

        def split(r: Column, p: Column) -> Column:
            at = r["b0"] + F.instr(inside(r), p["s"]) - 1
            either = F.array(
                F.struct(r["a0"].alias("a0"), p["i"].alias("a1"), r["b0"].alias("b0"), at.alias("b1")),
                F.struct((p["i"] + p["k"]).alias("a0"), r["a1"].alias("a1"), (at + p["k"]).alias("b0"), r["b1"].alias("b1")),
            )
            return F.struct(F.concat(rest, either).alias("todo"), (held["n"] + p["k"]).alias("n"))

        found = let(last, lambda r: let(F.get(fits(r), F.lit(0)), lambda p: F.when(p.isNull(), F.struct(rest.alias("todo"), held["n"].alias("n"))).otherwise(split(r, p))))
        return F.when(F.size(held["todo"]) == 0, held).otherwise(found)

    whole = F.array(F.struct(F.lit(0).alias("a0"), F.length(word).alias("a1"), F.lit(0).alias("b0"), F.length(text).alias("b1"))).cast(RANGES)
    return F.aggregate(F.sequence(F.lit(0), F.length(word) * 2), F.struct(whole.alias("todo"), F.lit(0).alias("n")), look, lambda held: held["n"])


def likeness(word: Column, text: Column, least: float = 0.0) -> Column:
    """From 0 to 1; 0 where the characters alone tell that it is below ``least``.  The word is not empty; which one is the word tells the order of blocks."""
    total = F.length(text) + F.length(word)
    known = lambda a, b: F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    bound = 2.0 * F.least(known(text, word), known(word, text)) / total
    shared = F.filter(pieces(word), lambda p: F.contains(text, p["s"]))  # few, where each look would try all pieces
    return F.when(bound >= least, 2.0 * let(shared, lambda parts: common(word, parts, text)) / total).otherwise(F.lit(0.0))


def meant(names: Sequence[str], text: Column) -> Column:
    """The name that is likest to the text, the last in the alphabet of equally like ones; null if none is like enough."""
    each = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(likeness(n, text, MEANT).alias("r"), n.alias("name")))
    return F.array_max(F.filter(each, lambda x: x["r"] >= MEANT))["name"]
