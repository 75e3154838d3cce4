"""Suffix arrays and removals against sorting and searching every string."""

import hashlib
import random

import numpy as np

from pagewright.llm import suffix_dedup
from pagewright.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for text in [b"", b"a", b"aaaa", b"banana", b"mississippi", b"abcabcabc", bytes(range(256)), b"\x00\x00a\x00", *(bytes(rng.choices(b"ab", k=rng.randrange(1, 45))) for _ in range(80))]:
        order = suffix_array(np.frombuffer(text, np.uint8)).tolist()
        assert sorted(order) == list(range(len(text)))
        assert [text[i:] + b"\x00" * (60 - len(text) + i) for i in order] == sorted(text[i:] + b"\x00" * (60 - len(text) + i) for i in order)
    for _ in range(20):
        text = bytes(rng.choices(b"abc", k=500)) * 2
        order = suffix_array(np.frombuffer(text, np.uint8))
        heads = [text[i : i + 50] for i in order]
        assert [h.ljust(50, b"\x00") for h in heads] == sorted(h.ljust(50, b"\x00") for h in heads)
        near = common_prefixes(np.frombuffer(text, np.uint8), order)
        pad = text + b"\x00" * 60
        for i, n in enumerate(near):
            a, b = pad[order[i] : order[i] + 50], pad[order[i + 1] : order[i + 1] + 50]
            assert n == next((j for j in range(50) if a[j] != b[j]), 50)


def brute(documents):
    first = {}
    for d, text in documents:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, text in documents:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, documents):
    df = spark.createDataFrame([(d, t, d % 3) for d, t in documents], "doc_id long, text string, block int")
    assert sorted(tuple(r) for r in remove_repeats(df).collect()) == brute(documents)


def cases():
    rng = random.Random(7)
    pool = ["an", "été", "b2", "ñandú", "Zo", "kin", "lo", "xyz", "qu"]
    make = lambda n: " ".join(rng.choices(pool, k=n)) + str(rng.random())
    passages = [make(n) for n in (8, 11, 12, 14, 30, 60)] + ["x" * 49, "x" * 50, "ab" * 60]
    documents = [(0, None), (1, ""), (2, "short"), (3, "x" * 120), (4, "x" * 121)]
    for i in range(60):
        parts = [make(rng.randrange(0, 25)), rng.choice(passages), make(rng.randrange(0, 25)), rng.choice(passages)]
        rng.shuffle(parts)
        documents.append((10 + i, rng.choice(["", " ", "\n"]).join(parts)))
    documents += [(200 + i, documents[10][1]) for i in range(5)] + [(300, documents[20][1] + "tail"), (301, "head" + documents[20][1][:200])]
    documents += [(11, documents[6][1]), (77, "same row " * 20), (77, "same row " * 20)]
    documents.append((500, make(4000) + passages[4] + make(4000)))
    rng.shuffle(documents)
    return documents


def test_every_string(spark):
    check(spark, cases())


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "PART", 5_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 7)
    check(spark, cases())


def test_missing_ids(spark):
    """A null doc_id counts as larger than any other, and null ones don't affect each other."""
    text = "a string that is long enough to be found again " * 3
    df = spark.createDataFrame([(5, text), (None, text), (None, "other words, also long enough to be found again, twice over"), (None, "other words, also long enough to be found again, twice over")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect()) == [(0, 59, 0), (0, 59, 0), (0, 141, 141), (5, 141, 0)]


def test_rows_that_repeat_an_id(spark, monkeypatch):
    """A row whose doc_id also has a copy of an earlier text keeps its own text; many rows without id; blocks by bytes."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    t, u, v = (" ".join(f"{w}{i * i}" for i in range(20)) for w in ("one", "two", "six"))
    rows = [(1, t), (5, t), (5, u), (5, u), (7, u + v), (None, v), (None, t + "!"), *((None, f"{u} {i % 3}") for i in range(40)), (9, None), (None, None)]
    last = 2**63 - 1
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((last if r.doc_id is None else r.doc_id, *r[1:]) for r in found) == brute([(last if d is None else d, x) for d, x in rows])
    assert [r.n_removed for r in found if r.doc_id == 5].count(0) == 2


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "")])
