"""Groups of similar texts against comparing every pair of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm.similar import keep_first, most_similarity, shingle_sets, similar_groups, sketch


def brute_similar(texts, size=5, similarity=0.8):
    sets = {}
    for d, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts, made = [None, "", " ", "one", "One", "a b c d"], []
    for _ in range(n):
        words = rng.choices(["the", "of", "and"], k=30) + rng.choices(pool, k=rng.randrange(20, 400))
        rng.shuffle(words)
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            copy = words[:]
            for _ in range(max(1, int(len(copy) * rng.choice([0.002, 0.01, 0.018])))):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append("\n".join(copy))
    rng.shuffle(texts)
    return dict(enumerate(texts, 3))


def test_similar_groups(spark):
    texts = near_copies(4, 70)
    df = spark.createDataFrame([*((d, t, "k") for d, t in texts.items()), (None, "no id", "k"), (None, None, "k")], "doc_id long, text string, keys string")
    expected = brute_similar(texts)
    assert len(set(expected.values())) < 80
    rows = {r.doc_id: r.component_id for r in similar_groups(df).collect()}
    assert rows == expected
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({*expected.values()})
    assert kept.where("doc_id is null").count() == 2
    assert keep_first(df.limit(0)).count() == 0


def test_large_group(spark, monkeypatch):
    """Joins by shuffle."""
    from pagewright.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = {}
    for d in range(80):
        copy = base[:]
        for _ in range(2):
            copy[rng.randrange(300)] = f"x{d}"
        texts[d] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in similar_groups(df).collect()} == {0}
    assert [r.doc_id for r in keep_first(df).collect()] == [0]


def test_copies_of_one_text(spark):
    """Many copies that are similar to their original but not to each other; the original is neither first nor last."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(420)]
    texts = {500: " ".join(base)}
    for d in range(470, 560):
        copy = base[:]
        for at in rng.sample(range(10, 410), 8):
            copy[at] = f"x{d}y{at}"
        texts.setdefault(d, " ".join(copy))
    expected = brute_similar(texts)
    assert set(expected.values()) == {470}
    sets = brute_similar({d: t for d, t in texts.items() if d != 500})
    assert len(set(sets.values())) > 10
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == expected


def test_crowd_of_separate_pairs(spark):
    """Texts of one vocabulary share every key; each has one copy of its own."""
    rng = random.Random(21)
    pool = [f"w{i}" for i in range(300)]
    texts = {}
    for d in range(60):
        words = pool[:]
        rng.shuffle(words)
        texts[d] = " ".join(words)
        at = rng.randrange(280)
        words[at], words[at + 1] = words[at + 1], words[at]
        texts[1000 + rng.randrange(10**6) * 100 + d] = " ".join(words)
    expected = brute_similar(texts)
    assert len(set(expected.values())) == 60
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == expected


def test_pairs_near_the_threshold(spark):
    """Copies with a tenth of the words appended, cut off or replaced in one passage, down to a similarity of 0.8."""
    rng = random.Random(22)
    pool = [f"v{i}" for i in range(100000)]
    texts = {}
    for i in range(150):
        words, m = rng.sample(pool, 200), rng.randrange(10, 50)
        at = rng.randrange(150)
        copy = words + rng.sample(pool, m) if i % 3 == 0 else words[: 200 - m * 3 // 4] if i % 3 == 1 else words[:at] + rng.sample(pool, min(m, 17)) + words[at + min(m, 17) :]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(copy)
    expected = brute_similar(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == expected


def test_pairs_of_a_template(spark):
    """All texts share most of a template; each has one copy, and only that is similar enough."""
    rng = random.Random(31)
    base = [f"t{i}" for i in range(420)]
    texts = {}
    for d in range(300):
        own = base[:]
        for at in rng.sample(range(420), 8):
            own[at] = f"x{d}y{at}"
        texts[d] = " ".join(own)
        own[rng.randrange(420)] = f"z{d}"
        texts[1000 + d] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == {d: d % 1000 for d in texts}


def test_links_between_followers(spark):
    """Two originals that are not similar have copies that are."""
    rng = random.Random(32)
    texts, d = {}, 0
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        far = base[:]
        for at in range(0, 72, 6):
            far[at] = f"f{rng.randrange(10**6)}"
        for origin in (base, far):
            for _ in range(12):
                copy = origin[:]
                for at in rng.sample(range(100, 300), rng.randrange(4)):
                    copy[at] = f"c{rng.randrange(10**6)}"
                for at in rng.sample(range(0, 72, 6), rng.randrange(9)):
                    copy[at] = (far if origin is base else base)[at]
                texts[d := d + 1] = " ".join(copy)
    expected = brute_similar(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == expected


def test_rows_that_repeat_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    one, two, other = " ".join(base), " ".join([*base, "more"]), " ".join(base[::-1])
    rows = [(5, one, 1), (5, other, 2), (7, two, 3), (3, other, 4), (9, two, 5), (9, two, 5), (2, None, 6), (4, "", 7), (None, one, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert sorted(r.node for r in keep_first(df).collect()) == [1, 4, 6, 8]


def test_recall_on_the_tables(spark):
    """All documents of a table: every pair that shares a shingle."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    sets, holders, parent = {}, {}, {}
    for r in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        parent[r.doc_id] = r.doc_id
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, own in sets.items():
        for e in {e for s in own for e in holders[s] if e < d}:
            if min(len(own), len(sets[e])) >= 0.8 * max(len(own), len(sets[e])) and len(own & sets[e]) >= 0.8 * len(own | sets[e]):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == {d: find(d) for d in parent}


def test_sketches_never_deny():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 600), replace=False)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert most_similarity(sketch(a), len(a), sketch(b), len(b)) >= both / (len(a) + len(b) - both) - 1e-12


def test_shingles_of_odd_texts():
    texts = ["", "One", "one", "a b c d e f", "A\x0bB\tc\nd  e f ", "é " * 9, "w" * 300 + " x", "w" * 299 + "v x"]
    found = list(shingle_sets(pa.array(texts), 5))
    assert [len(s) for s, _ in found] == [0, 1, 1, 2, 2, 1, 1, 1]
    assert found[1][1] == found[2][1] and found[3][1] == found[4][1] and found[6][1] != found[7][1]


def test_stage_starts_from_fingerprints(spark, monkeypatch):
    """The pipeline's stage links texts by SimHash first: each text's fingerprint is that of operator 2, and its groups' pairs are used."""
    import corpus_pipeline
    from pagewright.llm import similar, simhash

    seen = []
    monkeypatch.setattr(similar, "fingerprint_groups", lambda marked: seen.append(marked) or simhash.fingerprint_groups(marked))
    words = [f"w{i * 7 % 5003}" for i in range(6000)]
    texts = {3: " ".join(words), 5: "\n".join(words[:5999]), 8: "something else that is said only here"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [3, 8]
    assert {r.fp for r in seen[0].collect()} == {r.fp for r in simhash.fingerprints(docs).collect()}
    firsts = seen[0].select(F.col("doc_id").alias("node"), "fp")
    assert similar.printed_pairs(firsts).count() == 1
