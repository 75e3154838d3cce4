"""Golay keys and components against comparing every pair."""

import random
import re

import numpy as np
import xxhash

from pagewright.llm.simhash import fingerprints, golay_keys, golay_tables, near_duplicates, report


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_two_errors_share_a_codeword():
    tables = golay_tables()
    assert len({int(x) for x in tables[1]}) == 2048
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(23)
        y = x ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        _, a = golay_keys(np.array([x]), tables)
        _, b = golay_keys(np.array([y]), tables)
        assert set(a) & set(b)
        assert len(a) in (1, 6)


def test_documents(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(30)] + ["é", "Ñu", " x", " "]
    texts = [None, "", " \t\n", "One", "one", "two words", "TWO\x0bwords", "a b c", "a b"]
    for _ in range(60):
        base = rng.choices(pool, k=rng.randrange(1, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            base = base[:]
            base[rng.randrange(len(base))] = "zz"
            texts.append("\n".join(base))
    documents = list(enumerate(texts, 5))
    df = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, component_id int")
    prints = {d: brute_fingerprint(t) for d, t in documents}
    expected = brute_components(prints)
    for crowd in (48, 2):
        rows = report(near_duplicates(df, crowd=crowd)).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", expected[d]) for d in prints}


def test_chains_and_crowds(spark, monkeypatch):
    """Long chains, and many fingerprints close together, as given fingerprints."""
    from pagewright.llm import simhash

    rng = random.Random(3)
    values, chain = [0, (1 << 64) - 1], rng.getrandbits(64)
    for i in range(40):
        chain ^= 3 << (i % 60)
        values.append(chain)
    centre = rng.getrandbits(64)
    for _ in range(250):
        values.append(centre ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(4))))
    values += [rng.getrandbits(64) for _ in range(100)]
    rng.shuffle(values)
    prints = dict(enumerate(values))
    signed = [(d, v - (1 << 64) if v >> 63 else v) for d, v in prints.items()]
    monkeypatch.setattr(simhash, "fingerprints", lambda df, **_: spark.createDataFrame(signed, "doc_id long, fp long"))
    expected = brute_components(prints)
    for crowd in (48, 3):
        found = near_duplicates(spark.createDataFrame([(1, "")], "doc_id long, text string"), crowd=crowd).collect()
        assert {r.doc_id: r.component_id for r in found} == expected


def test_missing_ids(spark):
    df = spark.createDataFrame([(None, "one two three four"), (7, "one two three four"), (None, "a"), (None, None), (7, "again")], "doc_id long, text string")
    rows = report(near_duplicates(df)).collect()
    assert len(rows) == 5 and [r.component_id for r in rows if r.fingerprint == f"{brute_fingerprint('one two three four'):016x}"] == [7, 7]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert fingerprints(df).count() == 0
