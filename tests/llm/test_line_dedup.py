"""Removed lines against searching every earlier run."""

import random

from pagewright.llm.line_dedup import report, without_repeats


def brute(documents, window, long):
    seen, out = set(), {}
    for d, text in sorted(documents, key=lambda x: x[0]):
        lines = (text or "").split("\n")
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        runs = [full[i : i + window] for i in range(len(full) - window + 1)] + [[x] for x in full if len(x[1]) >= long]
        for run in sorted({tuple(r) for r in runs}):
            contents = tuple(x for _, x in run)
            if contents in seen:
                gone |= set(range(run[0][0], run[-1][0] + 1))
            seen.add(contents)
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def cases():
    rng = random.Random(11)
    pool = ["a", "b", "ü", "same line", "x" * 250, " padded ", "", "  \t", "c" * 199, "d" * 200]
    documents = [(0, None), (1, ""), (2, "\n\n"), (3, "a\na\na\na"), (4, "a"), (5, "x" * 250)]
    for i in range(70):
        documents.append((10 + i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randrange(150)}" for _ in range(rng.randrange(1, 12)))))
    documents.append((500, "\n".join(f"line {i % 700}" for i in range(5000))))
    documents += [(600 + i, documents[20][1]) for i in range(4)]
    return documents


def test_every_run(spark):
    documents = cases()
    df = spark.createDataFrame([(d, t, "m", 1) for d, t in documents], "doc_id long, text string, mark string, gone int")
    for window, long in ((2, 200), (3, 10_000), (1, 200)):
        found = report(without_repeats(df, window=window, long=long)).collect()
        assert {r.doc_id: tuple(r[1:]) for r in found} == brute(documents, window, long)
    assert without_repeats(df).columns == ["doc_id", "mark", "gone", "text", "n_lines", "n_removed"]


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "p\nq"), (1, "p\nq"), (2, "p\nq"), (None, "p\nq"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in without_repeats(df).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2)]
    assert without_repeats(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    """Each row loses its own repeats only: nothing that is found once goes."""
    long, other = "l" * 250, "u" * 250
    df = spark.createDataFrame([(1, long), (5, long), (5, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in without_repeats(df).collect()) == [(1, long, 0), (5, "", 1), (5, other, 0)]
    # of equal runs at the same line of two rows, one stays
    df = spark.createDataFrame([(5, f"{long}\n{x}") for x in "abc"] + [(5, f"{long}\na")], "doc_id long, text string")
    found = sorted((r.text, r.n_removed) for r in without_repeats(df).collect())
    kept = [t for t, n in found if n == 0]
    assert len(set(kept)) == 1 and kept[0].startswith(long) and len(found) == 4
    assert {t for t, n in found if n} == {"a", "b", "c"} - {kept[0][-1]}
