"""Balanced packing: every id of the tokenizers library once, no padding, even costs."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm.balanced import CAPACITY, PIECE, PLAIN, Words, cost, dealt, pack, packed, piece_ends, report

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    rng = random.Random(4)
    odd = ["é", "é", "İstanbul", "ſtone", "ŉ x", "don't I'll we've 12'34", "¼ª² a·b × ÷", "日本語 テスト", "🙂🙃", " a b  c", "Σίσυφος ΣΑΣ", "a_b __init__", "x\x1cy\x85z", "<|endoftext|>", "a<|startoftext|>b c",
           "It's 'S 'T 'RE O'RE", "µ°", "A\r\nB\tC\x0bD\x0cE", "ﬁ ǅ Ǆ", "İ", "a̧ b̈", " é", "Ÿ Ž Œ", "ÀÉÎ'S", "…—“q”", "+-*/=<>~`^", "\x00 \x7f"]
    plain = ["'", "'", "s", "t", "re", "ve", "ll", "d", "m", "R", "é", "Й", "…", "—", "!", "_", "5", " ", "\n", "-"]
    made = [None, "", " ", "\n\n", *odd]
    made += ["".join(rng.choice(rng.choice(odd) + "ab 'é\n") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    made += [" ".join(rng.choices(["stone", "River,", "sing!", "über", "l'été", "x" * 30], k=rng.randrange(1, 260))) for _ in range(150)]
    made += ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    return [*made, "long word " * 9_000, "y" * 3_000, "a " + "z'" * 800 + " b", "7" * 2_000]


def test_same_ids():
    tokenizer = Tokenizer.from_file(PATH)
    words = Words(open(PATH, encoding="utf-8").read())
    every = [t or "" for t in texts()]
    for part in (every[:100], every[100:], every):
        for t, ids in zip(part, words.encoded(part, 2), strict=True):
            assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_pieces():
    for t in (t.lower() for t in texts() if t and PLAIN.fullmatch(t)):
        raw = t.encode()
        _, ends = piece_ends(np.frombuffer(raw, np.uint8))
        at, found = 0, []
        for stop in (np.flatnonzero(ends) + 1).tolist():
            found.append(raw[at:stop].decode().strip())
            at = stop
        assert found == PIECE.findall(t)


def test_merging_by_rank():
    """Merging each token's own text ends with the token's own pair, and later pairs have higher ids."""
    spec = json.loads(open(PATH, encoding="utf-8").read())
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    ids = [spec["model"]["vocab"][a + b] for a, b in pairs]
    assert ids == sorted(set(ids)) and ids[0] > max(i for t, i in spec["model"]["vocab"].items() if len(t.removesuffix("</w>")) == 1)
    for a, b in pairs:
        units = list((a + b).removesuffix("</w>"))
        units[-1] += "</w>" if b.endswith("</w>") else ""
        while len(units) > 2:
            i = min(range(len(units) - 1), key=lambda k: rank.get((units[k], units[k + 1]), len(pairs)))
            units[i : i + 2] = [units[i] + units[i + 1]]
        assert tuple(units) == (a, b)


def held_against_library(rows, documents, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    whole = {}
    for d, t in documents:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        whole.setdefault(d, []).append(ids)
    by_doc, sequences = {}, {}
    for r in rows:
        assert r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == whole.keys()
    for d, every in whole.items():
        for n in {len(ids) for ids in every}:
            alike = [ids for ids in every if len(ids) == n]
            own = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[d] if r.doc_tokens == n)
            assert sum(r[1] for r in own) == n * len(alike)
            for start, length, crc in own:
                assert crc in {zlib.crc32(ids[start : start + length].tobytes()) for ids in alike}
            if len(alike) == 1:
                assert [r[0] for r in own] == [0, *np.cumsum([r[1] for r in own])[:-1].tolist()]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return sequences


@pytest.mark.parametrize("capacity", [64, CAPACITY])
def test_documents(spark, capacity):
    documents = [*enumerate(texts()), (60, "again and"), (60, "again and"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, ids int").repartition(3)
    sequences = held_against_library(report(pack(df, PATH, capacity=capacity, group=8)).collect(), documents, capacity)
    total = sum(n for pieces in sequences.values() for _, n in pieces)
    assert sum(sum(n for _, n in pieces) < capacity for pieces in sequences.values()) <= 3 * 12
    assert len(sequences) <= total // capacity + 3 * 12


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_against_library(report(pack(documents, PATH)).collect(), [(r.doc_id, r.text) for r in documents.collect()], CAPACITY)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def spread(pieces):
    """Of the full sequences: the largest cost over the mean, the standard deviation over the mean; and the pieces."""
    spent: dict[int, list[int]] = {}
    for sequence, n in pieces:
        spent.setdefault(sequence, []).append(n)
    full = [sum(cost(n) for n in held) for held in spent.values() if sum(held) == CAPACITY]
    return max(full) / np.mean(full), np.std(full) / np.mean(full), len(pieces)


def test_costs():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.5, 1.1, 6000).astype(int) + 1, 3000)
    documents = [(i, np.zeros(n, np.uint32)) for i, n in enumerate(lengths)]
    made = lambda **more: spread([(s, len(ids)) for _, _, ids, _, s, _ in packed(iter(documents), group=128, **more)])
    ends = np.union1d(np.cumsum(lengths), np.arange(0, lengths.sum(), CAPACITY))  # in the order they come, cut where a sequence ends
    naive = spread([((b - 1) // CAPACITY, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    whole, cut = made(), made(longest=512)
    assert whole[0] < naive[0] and whole[2] < naive[2] - 300
    assert cut[0] < 1.01 and cut[1] < 0.01


@pytest.mark.parametrize("seed", range(5))
def test_dealt(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 150) for _ in range(40)]
    total = sum(lengths)
    rooms = [64] * (total // 64) + [1 << i for i in range(6) if total % 64 >> i & 1]
    pieces = dealt(lengths, rooms)
    assert sorted((to, offset + i) for _, _, n, to, offset in pieces for i in range(n)) == [(to, i) for to, n in enumerate(rooms) for i in range(n)]
    assert sorted((d, at + i) for d, at, n, _, _ in pieces for i in range(n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
