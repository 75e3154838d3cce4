"""Winnowed matches against a search of every window."""

import hashlib
import random
import re
import time

import pyarrow as pa

from pagewright.llm.decontaminate import Index, clean_documents, contaminated_spans, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items):
    out = {}
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit |= set(range(i, i + n))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, documents, items, **options):
    docs = spark.createDataFrame([(d, t, "x") for d, t in documents], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = report(contaminated_spans(docs, bench, **options)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute(documents, items)
    assert len(rows) == len(documents)


def cases():
    rng = random.Random(5)
    pool = ["an", "été", "b2", "ñandú", "Zo", "kin", "lo"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 8, 9, 10, 11, 25, 60])))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "!?"), (93, items[3][1]), (94, "a " * 40)]
    documents = [(0, None), (1, ""), (2, "... !"), (3, "a " * 9), (4, "A-" * 200)]
    for i in range(60):
        text = " ".join(rng.choices([*pool, "uu", "vv"], k=rng.randrange(0, 90)))
        if i % 3 == 0:
            w = rng.choice(items)[1] or ""
            text += "\n" + w.upper().replace(" ", ", ") + " " + text
        documents.append((10 + i, text))
    documents.append((999, " ".join(rng.choices(pool, k=40_000)) + " " + items[0][1]))
    return documents, items


def test_every_window(spark):
    check(spark, *cases())


def test_blocks_of_the_benchmark(spark):
    check(spark, *cases(), block_words=300)


def test_rows_that_repeat_an_id_and_items_without(spark):
    """Each row is for itself, whatever the blocks; an item without id hits but isn't counted."""
    item = "one two three four five six seven eight nine ten eleven"
    other = "red green blue"
    docs = [(7, f"x {item} y", 1), (7, f"{other} {item}", 2), (7, None, 3), (None, other, 4), (None, "nothing here", 5), (None, f"a {other} {other}", 6), (8, "a no name b", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([("b", item), ("a", other), ("a2", other), (None, "no name"), ("z", None)], "item_id string, text string")
    expected = [(7, 13, 11, 1, True), (7, 14, 14, 3, True), (7, 0, 0, 0, False), (None, 3, 3, 2, True), (None, 2, 0, 0, False), (None, 7, 6, 2, True), (8, 4, 2, 0, True)]
    order = lambda rows: sorted(rows, key=str)
    for block_words in (1_000_000, 300, 5):
        rows = report(contaminated_spans(df, bench, block_words=block_words)).collect()
        assert order((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == order(expected)
        assert sorted(r.n_hit for r in clean_documents(df, bench, block_words=block_words).collect()) == [3, 5]


def test_index_of_a_million_words():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(50_000)]
    texts = pa.array([" ".join(rng.choices(pool, k=2000)) for _ in range(500)])
    began = time.process_time()
    index = Index([str(i) for i in range(500)], texts)
    assert time.process_time() - began < 10
    (_, _, hits), = index.matches(pa.array(["x " + texts[77].as_py()[:300]]))
    assert hits[0][0] == {"77"}


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])
