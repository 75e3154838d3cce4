"""Tries against nested dictionaries, also with colliding hashes and conversations that span partitions."""

import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import conversation_trie
from pagewright.llm.conversation_trie import running_sums, trie


def content_hash(role, text):
    h = 42
    for x in (role, text):
        h = xxhash.xxh64(x.encode(), seed=h % (1 << 64)).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(rows, share=5, most=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", content_hash(role or "", text or ""), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c in sorted(own):
        base, h = c - (abs(c) % share) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % most
        whole = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append(c)
        nodes[tuple(whole)].append(("end", c))
    out = []
    for path, held in nodes.items():
        members, ends = [m for m in held if not isinstance(m, tuple)], [m[1] for m in held if isinstance(m, tuple)]
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        n = {p: sum(not isinstance(m, tuple) for m in nodes[p]) for p in below}
        saved = sum((n[p] - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(m for m in nodes[path[:-1]] if not isinstance(m, tuple)) if path else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(path), parent, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, digest))
    return out


def cases(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.15:
            continue
        turns = rng.choice([1, 2, 3, 5, 9, 14])
        for i in range(turns):
            text = rng.choice(["same", "é", "", None]) if rng.random() < 0.7 else f"text {rng.randrange(6)}"
            rows.append((c, i, rng.choice(["user", "user", None]), text))
    rows += [(300, None, "user", "n"), (300, None, "user", "m"), (300, 2, "a", "x"), (300, 2, "a", "y"), (300, 2, "a", "x"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, i, "user", f"long {i % 7}") for c in (400, 401, 402) for i in range(400)]
    rows += [(c, i, "user", f"copy {i}") for c in range(500, 560) for i in range(3)]
    rng.shuffle(rows)
    return rows


def as_text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("bits", [64, 11])
def test_every_node(spark, bits):
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, fp int, h string")
    found = trie(df, bits=bits)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert as_text(found.collect()) == as_text(brute(rows))


def test_one_long_conversation(spark):
    """Most rows are of one conversation, and partitions are cut in the midst of others."""
    rows = [(3, i, "user", "t") for i in range(900)] + [(c, i, "user", f"{c % 3} {i}") for c in (0, 1, 2, 4, 5, 6) for i in range(c + 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert as_text(trie(df).collect()) == as_text(brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("seed", range(3))
def test_a_row_a_partition(spark, seed):
    """Bounds of partitions between any two turns: base and own turns are carried on."""
    rng = random.Random(seed)
    rows = [(c, i, "user", rng.choice("ab")) for c in range(12) for i in range(rng.randrange(1, 6))]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert as_text(trie(df).collect()) == as_text(brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(df).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], df.schema)).count() == 0


def test_running_sums(spark):
    rows = [(k, i, (k * i) % 5 - 1) for k, n in ((1, 700), (2, 1), (3, 40), (4, 300)) for i in range(n)]
    found = running_sums(spark.createDataFrame(rows, "k long, i long, v long"), "k", F.col("i").desc(), {"v": "s"}).collect()
    for k in (1, 2, 3, 4):
        own = sorted((r for r in found if r.k == k), key=lambda r: -r.i)
        at = 0
        for r in own:
            at += r.v
            assert r.s == at


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_IDS", 7)
    rows = [(5 * c, 0, "user", "same") for c in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_text(trie(df).collect()) == as_text(brute(rows))
