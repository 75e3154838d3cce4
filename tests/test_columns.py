"""Columns that stand for library functions: character references, case folding, unknown tags, likeness of names."""

import difflib
import html
import math
import random
import re
from html.entities import html5

from pyspark.sql import functions as F

from pagewright.config import HTML_TAGS, PREVIEW_SNIPPET
from pagewright.functions.folding import folded
from pagewright.functions.likeness import likeness
from pagewright.functions.markup import unescaped, unknown_tags, visible_text
from pagewright.functions.text import visible
from pagewright.operators.cards import chi2_tail
from pagewright.operators.layout import multi_column, multi_column_rows
from pagewright.sources.decks import hint


def values(spark, texts, made):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    assert not re.search("EvalPython|PythonUDF|MapInArrow|MapInPandas", df.select(made(F.col("t")).alias("v"))._jdf.queryExecution().executedPlan().toString())
    return [r.v for r in df.select("i", made(F.col("t")).alias("v")).orderBy("i").collect()]


def test_every_reference(spark):
    names = sorted(html5)
    texts = [f"a &{n} b &{n}c&{n.rstrip(';')}; &{n.rstrip(';')}1 &{n.upper()}" for n in names]
    numbers = [*range(0, 0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x1FFFF, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]
    texts += [f"&#{n}; &#{n} &#x{n:x}; &#X{n:X}z &#00{n};" for n in numbers]
    texts += ["", "&", "&&amp;;", "&;", "&#;", "&#x;", "&#xg", "& amp;", "&amp", "&ampamp;", "&notit;", "&notin;", "&" + "x" * 40 + ";", "&amp;lt;", "&é;", "&<b>&", "&#12&#34", "&lt&gt", "&a", "&copy&copy", "&\n;", "&0;", "&nbsp&#160;"]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "lt", "not", "in", "1", "9", "é", " ", "<", "frac", "12"]) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    assert values(spark, texts, unescaped) == [html.unescape(t) for t in texts]
    assert values(spark, [None], unescaped) == [None]


def test_visible(spark):
    texts = ["<p>a&eacute;b</p>\n &nbsp; c", "&lt;b&gt;", "<a <b>c>", " x\x1cy\x85z ", "no", "&#32;&#9;x", "<>", "&amp;lt;i&amp;gt;"]
    assert values(spark, texts, visible_text) == [visible(t) for t in texts]


def test_every_character_folds(spark):
    signs = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(signs[i : i + 4096]) for i in range(0, len(signs), 4096)] + ["ΑΣ ΑΣΑ Σ", "İI", "STRASSE straße", "", "ﬁﬂ ŉ", "plain"]
    assert values(spark, texts, folded) == [t.casefold() for t in texts]
    assert values(spark, [None], folded) == [None]


def unknown(text):
    """The same rule, read off the text at each tag's start."""
    out = []
    for m in re.finditer(r"</?\s*([A-Za-z][A-Za-z0-9-]*)", text):
        rest = text[m.end() :]
        closed = re.match(r"(\s[^<>]*)?/?>", rest)
        if m[1].lower() not in HTML_TAGS or not closed:
            head, sign, _ = text[m.start() : m.start() + PREVIEW_SNIPPET].partition(">")
            out.append(head + sign if sign else m[0])
    return out


def test_unknown_tags(spark):
    assert values(spark, ["<b>x</b> <List<int>> </nope> <code"], unknown_tags) == [["<List<int>", "<int>", "</nope>", "<code"]]
    rng = random.Random(6)
    parts = ["<", ">", "/", "b", "List", "int", " ", "x-1", "é", "</", "br/>", "<b>", "<i ", 'a="1"', "<foo>", "\xa0", "word word ", "<div class=x>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["", "<", "<b", "< b >", "</ b\n>", "<" * 50 + "x>", "<b <b <b <b <b <b <b <b <b <b <b <b>", "<x" * 2_000, "<x>" * 20_000]
    assert values(spark, texts, unknown_tags) == [unknown(t) for t in texts]
    assert values(spark, [None], unknown_tags) == [[]]


def test_chi2_tail(spark):
    xs = [0.0, 1e-9, 0.01, 0.5, 1.0, 3.0, 7.9, 7.999999, 8.0, 8.1, 11.344866730144373, 20.0, 50.0, 200.0, 700.0, *(i / 7 for i in range(400))]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    for r in df.withColumn("z", F.sqrt(F.col("x") / 2)).select("x", chi2_tail("z").alias("p")).collect():
        if r.x is None:
            assert r.p is None
        else:
            exact = math.erfc(math.sqrt(r.x / 2)) + math.sqrt(2 * r.x / math.pi) * math.exp(-r.x / 2)
            assert abs(r.p - exact) <= 1e-12 * max(exact, 1e-300) + 1e-14 * (r.x < 8), r.x


def test_columns_by_a_sweep(spark):
    """Against all pairs, also with heights of nothing or less; and a page of very many blocks."""
    rng = random.Random(9)
    text = "x" * 50
    made = lambda n: [(i, float(rng.choice((0, 40, 280, 320))), float(rng.randrange(40)), float(rng.choice((250, 300, 340, 600))), float(rng.randrange(40)), rng.choice((text, "short")), 0) for i in range(n)]
    pages = [(k, made(rng.randrange(0, 9))) for k in range(400)]

    def pairs(blocks):
        large = [b for b in blocks if len(b[5]) >= 40]
        left, right = [b for b in large if b[3] <= 306 + 612 * 0.05], [b for b in large if b[1] >= 306 - 612 * 0.05]
        return len(left) >= 2 and len(right) >= 2 and any(a[2] < b[4] and b[2] < a[4] for a in left for b in right)

    block = "struct<seq:int,x0:double,y0:double,x1:double,y1:double,text:string,type:int>"
    df = spark.createDataFrame(pages, f"k int, b array<{block}>")
    expected = {k: pairs(b) for k, b in pages}
    assert {r.k: r.m for r in df.select("k", multi_column(F.col("b"), F.lit(0.0), F.lit(612.0)).alias("m")).collect()} == expected
    rows, frame = df.select("k", F.explode("b").alias("b")).select("k", "b.*"), df.select("k", F.lit(0.0).alias("x0"), F.lit(612.0).alias("width"))
    assert {r.k: r.multi_column for r in multi_column_rows(rows, frame, ["k"]).collect()} == expected
    assert 20 < sum(expected.values()) < 380
    i = F.col("id")
    many = spark.range(100_000).select(F.struct(i.cast("int").alias("seq"), F.when(i % 2 == 0, 0.0).otherwise(320.0).alias("x0"), (i * 10.0).alias("y0"), F.when(i % 2 == 0, 300.0).otherwise(600.0).alias("x1"), (i * 10.0 + 10).alias("y1"), F.lit(text).alias("text"), F.lit(0).alias("type")).alias("b"))
    assert many.groupBy().agg(F.collect_list("b").alias("b")).select(multi_column(F.col("b"), F.lit(0.0), F.lit(612.0))).first()[0] is False


KNOWN = ["question", "answer", "options", "explanation"]


def near_names():
    rng = random.Random(5)
    names = [*KNOWN, "", "q", "Question", "questoin", "anwser", "option", "optoins", "explain", "explanations", "answers", "('question',)", "b'answer'", "5", "None", "qu€stion", "aaaa", "nnnnnnnnnnn", "question" * 5, "x" * 250, "😀question"]
    for word in KNOWN:
        for _ in range(60):
            held = list(word)
            for _ in range(rng.randrange(1, 6)):
                at, what = rng.randrange(len(held) + 1), rng.choice("dis")
                held[at : at + (what != "i")] = [] if what == "d" else [rng.choice("aeinopqstuxz")]
            names.append("".join(held))
    return names + ["".join(rng.choice("aenopqstu") for _ in range(rng.randrange(14))) for _ in range(200)]


def test_likeness(spark):
    names = near_names()
    for word in ["question", "explanation", "aab"]:
        assert values(spark, names, lambda t, word=word: likeness(F.lit(word), t)) == [difflib.SequenceMatcher(None, word, n, autojunk=False).ratio() for n in names]


def test_likeness_by_characters_first(spark):
    """A name that has too few of the word's characters isn't looked at; what is like enough keeps its figure."""
    assert values(spark, ["questoin", "anwser", "snare", "zzzzzz", ""], lambda t: likeness(F.lit("answer"), t, 0.6)) == [0.0, 10 / 12, 4 / 11, 0.0, 0.0]


def test_hints(spark):
    names = near_names()
    expected = [None if n in KNOWN else (difflib.get_close_matches(n, KNOWN, n=1) or [None])[0] for n in names]
    assert values(spark, names, hint) == expected
    assert {*KNOWN, None} == set(expected)
