"""Packing: every token once, ids of the tokenizers library, and near the fewest sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm.packing import best_fit, cut, exact_patterns, fitted, pack, plan, shares

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def check(spark, documents, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, length int")
    rows = pack(df, PATH, capacity=capacity).collect()
    expected = []
    for d, t in documents:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity
        starts = [0] * bool(first) + list(range(first, len(ids), capacity))
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(expected, key=order)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r[3] for r in expected)


def test_documents(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "été ñandú 12 don't  \n\n x", "<|endoftext|> in a text", " " * 500, "日本語 🙂 " * 50, "word " * 3000]
    texts += [" ".join(rng.choices(["stone", "river", "sing", "über"], k=rng.randrange(1, 160))) for _ in range(200)]
    documents = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, texts[9]), (None, "no id")]
    n, tokens = check(spark, documents, 128)
    assert n <= tokens / 128 * 1.03 + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths = rng.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(rng.geometric(0.05, 5000), capacity)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    groups = plan(histogram, capacity)
    used = np.zeros(capacity + 1, int)
    for held, n in groups:
        assert sum(held) <= capacity
        for x in held:
            used[x] += n
    assert (used == histogram).all()
    total = sum(n for _, n in groups)
    assert total <= max(sum(n for _, n in best_fit(histogram, capacity)) * 1.01 + 1, -(-lengths.sum() // capacity) * 1.01)
    assert len(shares(groups, histogram)[0]) == sum(len(set(held)) for held, _ in groups)
    patterns = exact_patterns(np.flatnonzero(histogram).tolist(), capacity)
    assert all(sum(p) == capacity for p in patterns)
    assert (fitted(patterns, histogram) >= 0).all()


def test_cut():
    assert cut(5, 5) == [(0, 5)] and cut(6, 5) == [(0, 1), (1, 5)] and cut(10, 5) == [(0, 5), (5, 5)]
