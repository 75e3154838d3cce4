"""Decks as a data source, and files as a committing sink: planning, filters, order, commit and abort."""

import os

import pytest
from pyspark.sql import datasource as S
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.ranges import page_list, page_sets
from pagewright.functions.text import zero_padded
from pagewright.sinks import files
from pagewright.sinks.pages import problem_images
from pagewright.sources import deck_source
from pagewright.sources.decks import RAW, parse_decks

CARD = "{'question': 'Q%d of %s?', 'answer': 'B', 'options': ['A', 'B', 'C', 'D']}"


def decks_in(folder, n=6, cards=3):
    folder.mkdir(exist_ok=True)
    for i in range(n):
        (folder / f"deck {i}.txt").write_text("[" + ", ".join(CARD % (k, i) for k in range(cards)) + "]")
    (folder / "_hidden.txt").write_text("no deck")
    (folder / ".part").mkdir(exist_ok=True)
    (folder / ".part" / "x.txt").write_text("no deck")
    return folder


def reader(folder, *filters, fields=("deck_id", "number"), **options):
    schema = T.StructType([f for f in T.StructType.fromDDL(RAW) if f.name in fields])
    made = deck_source.QuestionDecks({"path": str(folder), **options}).reader(schema)
    return made, list(made.pushFilters(list(filters)))


def opened(made):
    return [path.rpartition("/")[2] for p in made.partitions() for _, path in p.files]


def test_same_as_the_parser(spark, tmp_path):
    folder = decks_in(tmp_path / "d")
    (folder / "bad.txt").write_bytes(b"\xff[")
    (folder / "note.md").write_text("[1]")
    found = deck_source.load(spark, str(folder), glob="*.txt")
    contents = [(str(p), bytearray(p.read_bytes())) for p in sorted(folder.glob("*.txt")) if p.name[0] != "_"]
    expected = parse_decks(spark.createDataFrame(contents, "deck_id string, content binary"))
    assert found.schema == expected.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    one = deck_source.load(spark, str(folder / "deck 1.txt"), ids="name")
    assert {r.deck_id for r in one.collect()} == {"deck 1"}


def test_partitions_by_bytes(tmp_path):
    folder = decks_in(tmp_path / "d", n=9)
    size = (folder / "deck 0.txt").stat().st_size + deck_source.OPENING
    made, _ = reader(folder, partitionBytes=str(size * 2))
    assert [len(p.files) for p in made.partitions()] == [2, 2, 2, 2, 1]
    assert len(opened(made)) == 9
    (folder / "deck 3.txt").write_text(" " * 3 * size)  # larger than a partition: alone
    assert [len(p.files) for p in reader(folder, partitionBytes=str(size * 2))[0].partitions()] == [2, 1, 1, 2, 2, 1]
    (tmp_path / "none").mkdir()
    assert [p.files for p in reader(tmp_path / "none")[0].partitions()] == [()]
    with pytest.raises(FileNotFoundError):
        reader(tmp_path / "nowhere")[0].partitions()


def test_filters_choose_files_and_cards(spark, tmp_path):
    folder = decks_in(tmp_path / "d")
    key = lambda i: f"{folder}/deck {i}.txt"
    made, left = reader(folder, S.EqualTo(("deck_id",), key(2)), S.GreaterThan(("number",), 1))
    assert opened(made) == ["deck 2.txt"] and left == []
    assert [r["number"] for p in made.partitions() for b in made.read(p) for r in b.to_pylist()] == [2, 3]
    made, left = reader(folder, S.In(("deck_id",), (key(0), key(4))), S.EqualTo(("question", "value"), "x"), S.IsNotNull(("deck_id",)), S.EqualNullSafe(("number",), None))
    assert opened(made) == ["deck 0.txt", "deck 4.txt"] and [f.attribute for f in left] == [("question", "value"), ("number",)]
    # through Spark: files that aren't chosen may as well be unreadable
    for i in (0, 1, 3, 5):
        (folder / f"deck {i}.txt").unlink()
        os.symlink(folder / "gone", folder / f"deck {i}.txt")
    df = deck_source.load(spark, str(folder), ids="name").where(F.col("deck_id").isin("deck 2", "deck 4") & (F.col("number") <= 2) & F.col("question.value").contains("Q1"))
    assert sorted((r.deck_id, r.number, r.question.value) for r in df.collect()) == [("deck 2", 2, "Q1 of 2?"), ("deck 4", 2, "Q1 of 4?")]


def test_fewer_columns(spark, tmp_path, monkeypatch):
    folder = decks_in(tmp_path / "d", n=2)
    df = deck_source.load(spark, str(folder), columns=("deck_id", "number", "answer"))
    assert df.columns == ["deck_id", "number", "answer"] and {r.answer.value for r in df.collect()} == {"B"} and df.count() == 6
    monkeypatch.setattr("pagewright.sources.decks.text_field", lambda value: (_ for _ in ()).throw(AssertionError("not wanted")))
    made, _ = reader(folder)
    assert [b.schema.names for p in made.partitions() for b in made.read(p)] == [["deck_id", "number"]]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format(deck_source.FORMAT).schema("deck_id string, level int").load(str(folder)).collect()


def pieces(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n int, piece string")


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.name != files.DONE and not p.name.endswith(".crc")}


def test_files_in_order(spark, tmp_path):
    rows = [(f"k{i % 7}", i, f"{i}\n") for i in range(700)]
    files.save(pieces(spark, *reversed(rows), ("k1", -1, "head\n"), ("k2", 9999, None)), str(tmp_path / "out"), name=F.concat("k", F.lit(".txt")), order=["n"])
    expected = {f"k{j}.txt": "".join(t for k, _, t in rows if k == f"k{j}") for j in range(7)}
    assert contents(tmp_path / "out") == expected | {"k1.txt": "head\n" + expected["k1.txt"]}
    assert (tmp_path / "out" / files.DONE).exists()
    back = {r.name: r.content for r in files.read(spark, str(tmp_path / "out")).collect()}
    assert back == contents(tmp_path / "out")


def test_separators_and_trimming(spark, tmp_path):
    rows = [("a", 1, "x \n"), ("a", 2, " \n\n"), ("a", 3, "y"), ("a", 4, "  "), ("a", 5, "\n\t\n"), ("b", 1, "\n"), ("c", 1, "z")]
    files.save(pieces(spark, *rows), str(tmp_path / "t"), name=F.col("k"), order=["n"], trim=True, separator="|")
    assert contents(tmp_path / "t") == {"a": "x \n| \n\n|y|  |\n".rstrip() + "\n", "b": "\n", "c": "z\n"}


def test_modes(spark, tmp_path):
    out, save = tmp_path / "m", lambda mode, *rows: files.save(pieces(spark, *rows), str(tmp_path / "m"), name=F.col("k"), order=["n"], mode=mode)
    save("error", ("a", 1, "1"), ("b", 1, "1"))
    with pytest.raises(Exception, match="has a file 'b' already"):
        save("error", ("b", 1, "2"), ("c", 1, "2"))
    assert contents(out) == {"a": "1", "b": "1"}
    save("replace", ("b", 1, "3"), ("d", 1, "3"))
    assert contents(out) == {"a": "1", "b": "3", "d": "3"}
    save("overwrite", ("d", 1, "4"), ("e", 1, "4"))
    assert contents(out) == {"d": "4", "e": "4"}
    save("overwrite")
    assert contents(out) == {}


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = pieces(spark, *((f"k{i}", i, "text") for i in range(40)))
    failing = rows.withColumn("piece", F.when(F.col("k") == "k33", F.raise_error(F.lit("broken row"))).otherwise(F.col("piece")))
    for df, said in ((failing, "broken row"), (rows.withColumn("k", F.when(F.col("n") == 20, "a/b").otherwise(F.col("k"))), "not a file name")):
        with pytest.raises(Exception, match=said):
            files.save(df, str(out), name=F.col("k"), order=["n"])
        assert not out.exists() or list(out.iterdir()) == []
    # rows that don't stand together are told, not written twice
    files.register(spark)
    with pytest.raises(Exception, match="don't stand together"):
        spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "name string, piece string").coalesce(1).write.format(files.FORMAT).mode("append").option("path", str(out)).save()
    assert list(out.iterdir()) == []


def test_attempts_that_do_not_count(tmp_path):
    """A task that ran twice: only the files of the attempt that the driver heard of are moved, and the rest goes."""
    import pyarrow as pa

    writer = files.NamedFilesWriter(str(tmp_path / "out"), "error")
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"name": n, "piece": p} for n, p in rows], pa.schema([("name", pa.string()), ("piece", pa.string())]))
    writer.write(iter([batch(("a", "lost"), ("c", "lost"))]))
    counts = writer.write(iter([batch(("a", "kept ")), batch(("a", "on"), ("b", "x"))]))
    writer.commit([counts, writer.write(iter([])), None])
    assert contents(tmp_path / "out") == {"a": "kept on", "b": "x"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [files.DONE, "a", "b"]


def test_names(spark):
    keys = ["a", "a/b c", ".x", "_y", "é+%", "..", "n" * 400, "", "n" * 399 + "m"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    found = {r.k: (r.name, r.back) for r in df.select("k", files.file_name(F.col("k"), ".txt").alias("name")).withColumn("back", files.key_of(F.col("name"), ".txt")).collect()}
    for k, (name, back) in found.items():
        assert "/" not in name and (not k or name[0] not in "._") and len(name) < 255 and name.endswith(".txt")
        assert back == k or len(k) > 300
    assert len({n for n, _ in found.values()}) == len(keys)


def test_page_sets(spark):
    """Sets of pages as bits of words, against sorted lists; also at the words' ends."""
    import random

    rng = random.Random(3)
    sets = {"a": [0], "b": [63, 64], "c": list(range(200)), "d": [1, 3, 5, 62, 63, 64, 65, 127, 128, 300], "e": [5, 5, 4], "f": [64, 192], "g": [127], "h": list(range(64, 128)), "i": [10**9, 10**9 + 1]}
    sets |= {f"r{i}": [rng.randrange(400) for _ in range(rng.randrange(1, 300))] for i in range(30)}
    rows = [(k, p) for k, held in sets.items() for p in held]
    df = spark.createDataFrame(rows, "doc_id string, page_no int")
    found = page_sets(df, {"all": F.lit(True), "even": F.col("page_no") % 2 == 0, "none": F.col("page_no") < 0})
    lists = {r.doc_id: r.t for r in df.groupBy("doc_id").agg(F.collect_list("page_no").alias("p")).select("doc_id", page_list(F.col("p")).alias("t")).collect()}
    for r in found.collect():
        assert (r["all"].n, r["all"].ranges) == (len(set(sets[r.doc_id])), lists[r.doc_id])
        even = sorted({p for p in sets[r.doc_id] if p % 2 == 0})
        assert (r.even.n, r.even.ranges) == (len(even), ", ".join(map(str, even))) and (r.none.n, r.none.ranges) == (0, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "partial_bit_or" in plan


def test_image_names_of_long_documents(spark):
    results = spark.createDataFrame([("d", n, True) for n in (7, 999, 1000, 1234, 12345)], "doc_id string, page_no int, is_problem boolean")
    for count, names in ((69, ["007", "999", "1000", "1234", "12345"]), (20_000, ["00007", "00999", "01000", "01234", "12345"])):
        counts = spark.createDataFrame([("d", count)], "doc_id string, page_count int")
        assert [r.image_name for r in problem_images(results, counts).orderBy("page_no").collect()] == [f"page_{n}.png" for n in names]
    assert spark.range(1).select(zero_padded(F.lit(1234), F.lit(69))).first()[0] == "1234"
