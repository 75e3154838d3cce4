"""The pipeline's stages against brute-force versions, one after another."""

import math
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import quality_rules
from pagewright.llm.quality_rules import BUCKETS, ORDER, SMOOTHING, THRESHOLD

from .test_decontaminate import brute as leaks
from .test_line_dedup import brute as line_runs
from .test_similar import brute_similar

SF = "/root/testdata/sf0.001"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def llrs(documents, trusted):
    def bins(text):
        raw = (text or "").encode()
        shift = 64 - BUCKETS.bit_length() + 1
        return [int.from_bytes(raw[i : i + ORDER], "big") * 0x9E3779B97F4A7C15 % 2**64 >> shift for i in range(len(raw) - ORDER + 1)]

    raw, target = Counter(), Counter()
    held = {d: bins(t) for d, t in documents}
    for d, b in held.items():
        raw.update(b)
        if d in trusted:
            target.update(b)
    n, share = sum(raw.values()), sum(raw.values()) / sum(target.values())
    q = {b: (raw[b] + 1) / (n + BUCKETS) for b in raw}
    weight = SMOOTHING * share * BUCKETS / 64
    w = {b: math.log((target[b] * share + weight * q[b]) / (n + weight)) - math.log(q[b]) for b in raw}
    return {d: sum(w[x] for x in b) / max(1, len(b)) for d, b in held.items()}


def verdicts(documents, trusted):
    scores = llrs(documents, trusted)
    out = {}
    for d, t in documents:
        b = base(t)
        out[d] = not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and scores[d] >= THRESHOLD
    return out, scores


def test_quality_rules(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = quality_rules.trusted_of(spark.read.parquet(f"{SF}/labels.parquet"))
    documents = [(r.doc_id, r.text) for r in df.collect()] + [(9001, None), (9002, ""), (9003, "# a | b <\n\nx\nx \nx"), (9004, "one two three " * 40)]
    more = spark.createDataFrame(documents, "doc_id long, text string")
    expected, scores = verdicts(documents, {r.doc_id for r in trusted.collect()})
    rows = quality_rules.report(quality_rules.verdicts(more, trusted)).collect()
    texts = dict(documents)
    assert len(rows) == len(documents)
    for r in rows:
        b = base(texts[r.doc_id])
        assert tuple(r)[1:6] == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert r.llr == pytest.approx(scores[r.doc_id], abs=1e-4)
        assert r.kept == expected[r.doc_id]
    assert {r.doc_id for r in quality_rules.kept_documents(more, trusted).collect()} == {d for d, k in expected.items() if k}
    assert quality_rules.verdicts(more.limit(0), trusted).count() == 0
    assert {r.llr for r in quality_rules.verdicts(more, trusted.limit(0)).collect()} == {0.0}


def test_quality_rules_on_odd_rows(spark):
    """Repeated rows, rows without id, a very long text, and columns named like the results."""
    good, bad = " ".join(f"word{i % 60}a{i}" for i in range(80)), "one two three " * 40
    rows = [(1, good, 5.0, False), (1, good, 5.0, False), (None, good, 1.0, True), (None, None, 0.0, True), (2, bad, 0.0, True), (3, good + " end" + " ".join(map(str, range(200_000))), 0.0, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, llr double, kept boolean")
    trusted = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    found = quality_rules.report(quality_rules.verdicts(df, trusted)).collect()
    assert len(found) == 6 and len({tuple(r) for r in found if r.doc_id == 1}) == 1
    expected, scores = verdicts([(i, r[1]) for i, r in enumerate(rows)], {0, 1})
    assert sorted(round(r.llr, 3) for r in found) == sorted(round(x, 3) for x in scores.values())
    kept = quality_rules.kept_documents(df, trusted)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == sorted(rows[i][1] for i, k in expected.items() if k)


def test_components(spark):
    """Chains, stars, cycles, repeated and loose edges, against joining sets."""
    import random

    from pagewright.llm.components import connected_components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 460)] + [(i, 300 + (i + 1) % 9) for i in range(300, 309)] + [(7, 7), (None, 3), (4, None), (9, 8), (8, 9), (9, 8)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    group = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            joined = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(joined, joined))
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: min(g) for n, g in group.items()}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_small_steps_leave_no_disk_behind(spark):
    """Shuffle files go when a table is written, and the tables of earlier rounds when the next round's are there."""
    import time
    from pathlib import Path

    from pagewright.llm.common import prepare, written
    from pagewright.llm.components import connected_components

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    prepare(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, kept = shuffled(), set(folder.iterdir())
    table = written(spark.range(1000).selectExpr("id % 50 AS k").distinct())
    for _ in range(40):
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left and table.count() == 50
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    for most in (200_000, 0):  # minima broadcast, and joined by a shuffle
        assert {(r.node, r.component) for r in connected_components(edges, broadcast_nodes=most).collect()} == {(i, 0) for i in range(101)}
    made = [p for p in set(folder.iterdir()) - kept if p.name.startswith("components-")]
    assert len(made) == 2 and all(len(list(p.iterdir())) == 1 for p in made)


def test_stages_with_odd_rows(spark):
    """Columns named like those that operators make, null texts and ids, repeated rows: no stage fails, and the columns stay."""
    text = " ".join(f"word{i * 7 % 90}" for i in range(120))
    names = ["n_removed", "n_lines", "mentions", "__id", "__h", "__gone", "node", "h", "row", "key", "bits", "kept", "spans", "items"]
    docs = spark.createDataFrame(
        [(d, t, "en", "s", len(t or ""), *("x" for _ in names)) for d, t in ((1, text), (1, text), (2, None), (None, text), (None, None), (3, ""), (4, text + " more"), (5, "a\na\nb"))],
        "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF)
        assert rows.columns == docs.columns, name
        found = [r.doc_id for r in rows.collect()]
        if name == "near_duplicates":
            assert sorted(found, key=str) == [1, 1, 2, 5, None, None]
        if name == "line_dedup":
            assert len(found) == 8
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 8
    line, other = "l" * 250, "u" * 250
    docs = spark.createDataFrame([(1, line, "en", "s", 250), (5, line, "en", "s", 250), (5, other, "en", "s", 250)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, SF).collect()) == [(1, line, 250), (5, "", 0), (5, other, 250)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = {r.doc_id for r in quality_rules.trusted_of(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    now = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    def step(stage, expected):
        nonlocal docs
        rows = corpus_pipeline.STAGES[stage][1](spark, docs, SF).checkpoint()
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        found = {r.doc_id: (r.text, r.n_chars) for r in rows.collect()}
        assert found == {d: (t, len(t)) for d, t in expected.items()}
        assert found
        docs = rows
        return expected

    kept, _ = verdicts(list(now.items()), trusted)
    now = step(0, {d: t for d, t in now.items() if kept[d]})
    runs = line_runs(list(now.items()), 2, 200)
    now = step(1, {d: runs[d][2] for d in now})
    groups = brute_similar(now)
    now = step(2, {d: t for d, t in now.items() if groups[d] == d})
    hit = leaks(list(now.items()), items)
    now = step(3, {d: t for d, t in now.items() if not hit[d][-1]})

    rows = corpus_pipeline.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    lengths = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in now.items()}
    found = Counter()
    for r in rows:
        found[r.doc_id] += r.length
    assert found == lengths
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= math.ceil(sum(lengths.values()) / 2048) + 1


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF)
        assert rows.columns == docs.columns and rows.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
