"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A text is split at line feeds; lines are compared without the blanks around them, and empty lines are passed over.
A run is ``window`` lines in a row, or one line of at least ``long`` characters.  In every run the line with the least
hash (MD5, so that equal hashes mean equal lines) is selected: the minima of sliding windows, so equal runs have equal
selected lines.  Only selected lines are shuffled, and of those only the ones that stand at several places go on.

At those places the match is extended both ways: over the lines before and after the selected one, as far as a run
that it is the minimum of can reach.  Runs with equal contents form a class, and all but its first run in order of
doc_id, text and line are repeats.  Repeats that touch or overlap join to longer runs, and their lines go.

No pairs are made.  Both groupings are summed up before their shuffle, and the joins' small sides are written first, so
that Spark can split a line that very many documents have.

Defined cases: a null text is an empty one and has one empty line; a document may lose every line; runs repeated inside
a document count too; rows with equal doc_id and text are one place, so they lose the same lines and don't count against
each other, while rows with equal doc_id and other texts are rows of their own, in the order of their texts' hashes; rows
without doc_id lose nothing; an empty table gives an empty result; n_lines,
n_removed and the text are put in place of columns of these names, and other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of, unused, written

WINDOW = 2
LONG = 200


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(text: Column, long: int) -> Column:
    """The lines that aren't empty: hash, number, and whether a line is a run by itself."""
    numbered = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("line")))
    full = F.filter(numbered, lambda x: x["line"] != "")
    return F.transform(full, lambda x: F.struct(F.unhex(F.md5(x["line"])).alias("h"), x["at"].alias("at"), (F.length(x["line"]) >= long).alias("long")))


def starts_of(n: Column, window: int) -> Column:
    """Where windows of n lines start."""
    return F.when(n >= window, F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def selected_lines(source: DataFrame, window: int, long: int) -> DataFrame:
    """(doc_id, row, part, own): each selected line with the lines around it that a run over it can hold, and its place in them."""
    # the minimum of a window, the first of equal ones
    least = F.transform(starts_of(F.size("hashed"), window), lambda i: i + F.array_position(F.slice("hashed", i + 1, window), F.array_min(F.slice("hashed", i + 1, window))).cast("int") - 1)
    alone = F.filter(F.transform("hashed", lambda x, i: F.when(x["long"], i)), lambda i: i.isNotNull())
    picked = source.select("doc_id", "row", hashed_lines(F.col("text"), long).alias("hashed")).select("doc_id", "row", "hashed", F.explode(F.array_distinct(F.concat(least, alone))).alias("i"))
    low = F.greatest(F.col("i") - (window - 1), F.lit(0))
    return picked.select("doc_id", "row", F.slice("hashed", low + 1, F.col("i") - low + window).alias("part"), (F.col("i") - low).alias("own"))


def runs_over(window: int) -> Column:
    """The runs that a selected line is the minimum of: contents, first and last line."""
    part, own = F.col("part"), F.col("own")

    def run(i: Column, size: int) -> Column:
        held = F.slice(part, i + 1, size)
        contents = F.unhex(F.md5(F.concat(F.lit(size.to_bytes(4, "big")), *(held[j]["h"] for j in range(size)))))
        return F.struct(contents.alias("contents"), held[0]["at"].alias("first"), held[size - 1]["at"].alias("last"))

    led = F.filter(starts_of(F.size(part), window), lambda i: (i <= own) & (own < i + window) & (F.array_min(F.slice(part, i + 1, window))["at"] == F.get(part, own)["at"]))
    return F.concat(F.transform(led, lambda i: run(i, window)), F.transform(F.filter(F.array(own), lambda i: F.get(part, i)["long"]), lambda i: run(i, 1)))


def row_of(text: str) -> Column:
    """What tells rows with equal doc_id apart."""
    return F.xxhash64(text_of(text))


def repeated_lines(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(doc_id, row, gone): the numbers of the lines to remove, of the rows that have any."""
    prepare(documents.sparkSession)
    source = documents.select(F.col(key).cast("long").alias("doc_id"), row_of(text).alias("row"), text_of(text).alias("text")).where("doc_id is not null")
    selected = selected_lines(source, window, long).withColumn("line", F.get("part", "own"))
    marked = selected.select(F.xxhash64("line.h").alias("mark"), F.xxhash64("doc_id", "row", "line.at").alias("place"), "doc_id", "row", "part", "own")
    shared = written(marked.groupBy("mark").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("mark"))
    # in order of document, text, then line; 30 bits of the text's hash have room, and only rows with equal doc_id need them
    exact = lambda x: F.lit(x).cast("decimal(38,0)")
    start = F.col("doc_id").cast("decimal(38,0)") * exact(1 << 62) + F.col("row").bitwiseAND(F.lit((1 << 30) - 1)).cast("decimal(38,0)") * exact(1 << 32) + F.col("first")
    near = written(marked.select("mark", "doc_id", "row", "part", "own").join(shared.hint("shuffle_hash"), "mark").select("doc_id", "row", F.explode(runs_over(window)).alias("r")).select("doc_id", "row", "r.*"))
    near = near.withColumn("start", start.cast("decimal(38,0)"))
    ends = near.groupBy("contents").agg(F.min("start").alias("lead"), F.max("start").alias("end"), F.min_by("row", "start").alias("lead_row"), F.min("row").alias("low"), F.max("row").alias("high"))
    leads = written(ends.where("lead < end or low < high").select("contents", "lead", "lead_row"))
    later = near.join(leads.hint("shuffle_hash"), "contents").where("start > lead or row <> lead_row")
    return later.select("doc_id", "row", F.explode(F.sequence("first", "last")).alias("line")).groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))


def without_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """The documents with repeated runs taken out of the text, and n_lines and n_removed, in place of columns of these names."""
    own, row, out = unused(documents, "__id", "__row", "__gone")
    gone = repeated_lines(documents, key=key, text=text, window=window, long=long).select(F.col("doc_id").alias(own), F.col("row").alias(row), F.col("gone").alias(out))
    # the texts stream past a hash table of a partition's removals instead of being sorted
    joined = documents.join(gone.hint("shuffle_hash"), (F.col(key).cast("long") == F.col(own)) & (row_of(text) == F.col(row)), "left")
    lines = lines_of(text_of(text))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
    rest = F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    made = {text: rest, "n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce(F.size(out), F.lit(0)).cast("long")}
    return joined.select(*(F.col(c) for c in documents.columns if c not in made), *(v.alias(k) for k, v in made.items()))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


ORACLE = f"""
WITH line AS (
  SELECT doc_id, p - 1 AS pos, string_split(coalesce(text, ''), chr(10))[p] AS raw
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(p)
), part AS (
  SELECT doc_id, pos, trim(raw, chr(32) || chr(9) || chr(13)) AS line FROM line WHERE trim(raw, chr(32) || chr(9) || chr(13)) <> ''
), pair AS (
  SELECT doc_id, pos AS first, lead(pos) OVER w AS last, line || chr(10) || lead(line) OVER w AS contents
  FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), run AS (
  SELECT * FROM pair WHERE last IS NOT NULL
  UNION ALL SELECT doc_id, pos, pos, line FROM part WHERE length(line) >= {LONG}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY contents ORDER BY doc_id, first) AS n FROM run
), gone AS (
  SELECT DISTINCT doc_id, pos FROM ranked, range(first, last + 1) AS r(pos) WHERE n > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
  coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
