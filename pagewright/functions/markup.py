"""HTML as a reader sees it, in columns: character references, visible text, tags that a browser would not know.

References are read as browsers read them: named ones with their semicolon, about a hundred old ones also without it and then
with the longest name that fits, and numbers in both bases, with what the standard says of numbers that are no characters.
The table of names is Python's.  It is a constant text, which Spark splits into buckets once, when it plans.
"""

from __future__ import annotations

import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HTML_TAGS, PREVIEW_SNIPPET
from .text import SPACE, let, looked_up, squeezed, table_text

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BUCKETS = 512
OLD = tuple(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))


def bucket_of(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@cache
def names_by_bucket() -> str:
    """The table of names in buckets, so that a search has few names to look at."""
    held: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, signs in html5.items():
        held[bucket_of(name)][name] = signs
    return "\2".join(map(table_text, held))


def named(name: Column) -> Column:
    """The characters of a reference's name; null if there is none of it."""
    bucket = (F.crc32(name) % BUCKETS).cast("int")
    return F.when(name.rlike("^[A-Za-z0-9]{2,40};?$"), looked_up(F.get(F.split(F.lit(names_by_bucket()), "\2"), bucket), name))


def character(number: Column) -> Column:
    """The character of a code point, by its UTF-16 units."""
    unit = lambda n: F.lpad(F.hex(n), 4, "0")
    over = number - 0x10000
    pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF).cast("long")) + 0xDC00))
    return F.decode(F.unhex(F.when(number < 0x10000, unit(number)).otherwise(pair)), "UTF-16BE")


def windows_signs() -> dict[int, str]:
    """What numbers from 128 to 159 stand for: the Windows code page, where it has a character."""
    return {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def numbered(body: Column) -> Column:
    """The character of a reference's number: ``#`` or ``#x``, digits, and maybe a semicolon."""
    hexadecimal = body.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?0*", ""), ";$", "")
    return let(F.when(F.length(digits) > 7, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long")).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long")), numbered_sign)


#: Characters that a number can't stand for.
NONE = "[\x01-\x08\x0b\x0e-\x1f\x7f\ufdd0-\ufdef" + "".join(chr(plane << 16 | low) for plane in range(17) for low in (0xFFFE, 0xFFFF)) + "]"


def numbered_sign(number: Column) -> Column:
    """What a number stands for: its character, with the standard's exceptions."""
    windows = windows_signs()
    sign = F.translate(F.regexp_replace(character(number), NONE, ""), "".join(map(chr, windows)), "".join(windows.values()))
    return F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\N{REPLACEMENT CHARACTER}").otherwise(sign)


def resolved(reference: Column) -> Column:
    """What a reference stands for; itself if it is none."""
    return let(F.substr(reference, F.lit(2)), lambda body: F.coalesce(stands_for(body), reference))


def stands_for(body: Column) -> Column:
    start = F.regexp_extract(body, f"^(?:{'|'.join(OLD)})", 0)
    old = F.when(start != "", F.concat(looked_up(F.lit(table_text({n: html5[n] for n in OLD})), start), F.substr(body, F.length(start) + 1)))
    return F.when(F.startswith(body, F.lit("#")), numbered(body)).otherwise(F.coalesce(named(body), old))


def unescaped(text: Column) -> Column:
    """The text with its character references resolved."""

    def made(t: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), resolved), F.array(F.lit("")))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.zip_with(F.split(t, REFERENCE, -1), found, lambda a, b: F.concat(a, b)), "")).otherwise(t)

    return let(text, made)


def visible_text(text: Column) -> Column:
    """What a reader sees of an HTML fragment: tags go first, then references are resolved, then white space is evened out."""
    return squeezed(unescaped(F.regexp_replace(text, "<[^>]*>", "")))


OPENING = rf"</?{SPACE}*[A-Za-z][A-Za-z0-9-]*"


def unknown_tags(text: Column) -> Column:
    """The fragments that a browser would take for an unknown or broken tag: as far as they close soon, else the tag's start.

    A tag is whole if what follows its name closes it before any other angle bracket, so only the text up to the next tag's
    start is looked at.  The fragment's end is looked for in its first characters, put together from the tags and texts that
    follow; so the time is in proportion to the text.
    """
    cut = lambda a: F.transform(a, lambda x: F.left(x, F.lit(PREVIEW_SNIPPET)))

    def fragments(held: Column) -> Column:
        starts = held["starts"]
        after = F.slice(held["between"], F.lit(2), F.greatest(F.size(held["between"]) - 1, F.lit(1)))
        return let(F.struct(starts.alias("starts"), after.alias("after"), F.zip_with(cut(starts), cut(after), lambda a, b: F.concat(a, b)).alias("steps")), lambda h: F.transform(h["starts"], lambda start, i: fragment(h, start, i)))

    def fragment(held: Column, start: Column, i: Column) -> Column:
        known = F.lower(F.regexp_extract(start, "[A-Za-z][A-Za-z0-9-]*$", 0)).rlike(f"^(?:{'|'.join(sorted(HTML_TAGS))})$")
        whole = F.get(held["after"], i).rlike(rf"^(?:{SPACE}[^<>]*)?/?>")
        near = F.left(F.array_join(F.slice(held["steps"], i + 1, F.lit(PREVIEW_SNIPPET // 2)), ""), F.lit(PREVIEW_SNIPPET))
        end = F.instr(near, ">")
        return F.when(~(known & whole), F.when(end > 0, F.left(near, end)).otherwise(start))

    def found(t: Column) -> Column:
        parts = F.struct(F.regexp_extract_all(t, F.lit(OPENING), F.lit(0)).alias("starts"), F.split(t, OPENING, -1).alias("between"))
        return F.when(F.contains(t, F.lit("<")), F.array_compact(let(parts, fragments))).otherwise(F.array().cast("array<string>"))

    return let(text, found)
