"""Rearranged texts against the same steps in plain Python, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm.fill_middle import Marks, rearranged, report, restored


def brute(doc_id, text, rate=100, spm_rate=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases():
    rng = random.Random(5)
    pool = ["a", "", "<", "<P", "P>", "🙂 é", "x" * 40, "\r", " ", "<m>", " "]
    texts = [None, "", "\n", "\n\n", "one", "<P>", "a\n<M>b\n", "<<S>>", "🙂a" * 30_000, "l\n" * 20_000]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x\ny\nz"), (None, None), (7, texts[20]), (7, texts[20]), (-3, "a\nb")]


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 50), (100, 0), (0, 100)])
def test_every_row(spark, rate, spm_rate):
    df = spark.createDataFrame([(d, t, "m", 1) for d, t in cases()], "doc_id long, text string, form string, __parts int")
    made = rearranged(df, rate=rate, spm_rate=spm_rate)
    assert made.columns == ["doc_id", "text", "__parts", "form", "n", "output", "prefix_chars", "middle_chars"]
    order = lambda x: tuple(map(str, x))
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted((tuple(r) for r in found), key=order) == sorted(((d, *brute(d, t, rate, spm_rate)) for d, t in cases()), key=order)
    assert made.where(restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0


def test_report(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(d, *brute(d, t)[:4], sha(brute(d, t)[4]), sha(t or "")) for d, t in cases()]
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in report(rearranged(df)).collect()), key=order) == sorted(expected, key=order)
    assert report(rearranged(df.limit(0))).count() == 0
    assert {r.form for r in report(rearranged(df)).collect()} == {"plain", "psm", "spm"}


def test_marks(spark):
    with pytest.raises(ValueError, match="overlap"):
        Marks(prefix="aba")
    with pytest.raises(ValueError, match="overlap"):
        Marks(prefix="<x", suffix="x>", middle="m")
    marks = Marks("[[p]", "[[s]", "[[m]")
    df = spark.createDataFrame([(i, "a.b\nc[[x]\n[[\nd") for i in range(40)], "doc_id long, text string")
    made = rearranged(df, marks=marks, units=r"\S+\s*|\s+", seed="s")
    assert made.where(restored(F.col("output"), F.col("form"), marks) != F.col("text")).count() == 0
    assert made.where("form = 'plain'").count() == 0
