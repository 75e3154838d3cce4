"""Decks as files: tab-separated rows, validation report, package, card templates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fixed_udf, tsv_field
from ..operators.cards import package_ids, question_groups
from . import files
from .pages import write_text

FRONT = """<section class="quiz">
  <h2 class="quiz-question">{{Question}}</h2>
  <ol class="quiz-choices" type="A">
    <li>{{OptionA}}</li>
    <li>{{OptionB}}</li>
    <li>{{OptionC}}</li>
    <li>{{OptionD}}</li>
  </ol>
</section>
"""
BACK = """<section class="quiz right-{{text:CorrectLetter}}">
  <h2 class="quiz-question">{{Question}}</h2>
  <ol class="quiz-choices" type="A">
    <li class="is-A">{{OptionA}}</li>
    <li class="is-B">{{OptionB}}</li>
    <li class="is-C">{{OptionC}}</li>
    <li class="is-D">{{OptionD}}</li>
  </ol>
  <p class="quiz-answer" id="answer"><b>{{CorrectLetter}}</b> {{CorrectAnswer}}</p>
  {{#Explanation}}<p class="quiz-why">{{Explanation}}</p>{{/Explanation}}
</section>
"""
STYLE = """.quiz { margin: 1rem auto; max-width: 42rem; text-align: left; font: 1.1rem/1.5 sans-serif; }
.quiz-question { font-size: 1.2rem; }
.quiz-choices li { margin: .4rem 0; padding: .3rem .6rem; border-left: 3px solid silver; }
.right-A .is-A, .right-B .is-B, .right-C .is-C, .right-D .is-D { border-left-color: green; font-weight: bold; }
.quiz-answer { color: green; }
.nightMode .quiz-answer { color: lightgreen; }
.quiz-why { font-size: .95rem; opacity: .85; }
"""
TEMPLATES = {"front_template.html": FRONT, "back_template.html": BACK, "styling.css": STYLE}


def tsv_line() -> Column:
    return F.concat_ws("\t", *(tsv_field(F.col(c)) for c in C.EXPORT_COLUMNS))


def tsv_header(deck_name: str | None = None, tags: list[str] | None = None) -> str:
    """The lines that tell the importer how to read the file."""
    lines = ["#separator:tab", "#html:true", f"#notetype:{C.NOTE_TYPE}"]
    lines += [f"#deck:{deck_name}"] * bool(deck_name) + [f"#tags:{' '.join(tags or [])}"] * bool(tags)
    return "".join(f"{x}\n" for x in [*lines, "#columns:" + "\t".join(C.EXPORT_COLUMNS)])


def tsv_pieces(rows: DataFrame, *, header: str = "") -> DataFrame:
    """(deck_id, number, piece): the lines of each deck's file in order, the header first."""
    lines = rows.select("deck_id", F.col("number").cast("long").alias("number"), F.concat(tsv_line(), F.lit("\n")).alias("piece"))
    return lines.unionAll(lines.select("deck_id").distinct().select("deck_id", F.lit(-1).cast("long"), F.lit(header))) if header else lines


def write_tsvs(rows: DataFrame, folder: str, *, header: str = "", mode: str = "error") -> None:
    """A file for each deck, ``deck_id`` with the ending .tsv."""
    files.save(tsv_pieces(rows, header=header), folder, name=files.file_name(F.col("deck_id"), ".tsv"), order=["number"], mode=mode)


def write_reports(pieces: DataFrame, folder: str, *, mode: str = "error") -> None:
    """A file for each deck's report."""
    files.save(pieces, folder, name=files.file_name(F.col("deck_id"), ".txt"), order=REPORT_ORDER, mode=mode, trim=True)


def distribution_lines(dist: DataFrame) -> DataFrame:
    """(deck_id, lines): a line a letter with its count and percentage."""
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(F.lit(0.0))
    line = lambda c: F.concat(F.lit(f"  {c}: "), F.lpad(F.col(c).cast("string"), 4, " "), F.lit(" ("), F.lpad(fixed_udf(share(c), F.lit(1)), 5, " "), F.lit("%)"))
    return dist.select("deck_id", F.concat_ws("\n", *map(line, C.LETTERS)).alias("lines"))


REPORT_ORDER = ["section", "number"]


def report_pieces(validated: DataFrame, decks: DataFrame, dist: DataFrame, after: DataFrame | None = None, *, seed: int | None = None) -> DataFrame:
    """(deck_id, section, number, piece): a report's pieces; in the order of section and number they make up the text.

    ``decks`` has deck_id, format and notes; ``dist`` and ``after`` are distributions with warnings, before and after
    shuffling.
    """
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    number = F.col("number").cast("string")
    at = lambda section, n=-1: (F.lit(section).alias("section"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("number"))
    prefixed = lambda lines, prefix: F.transform(lines, lambda x: F.concat(F.lit(prefix), x))
    bullet = lambda a: prefixed(F.transform(a, lambda m: m["message"]), "    - ")
    ended = lambda lines: text(F.array_join(lines, "\n"), "\n")
    piece = lambda section, made, n=-1: F.struct(*at(section, n), made.alias("piece"))
    inlined = lambda df, *made: df.select("deck_id", F.inline(F.array_compact(F.array(*made))))
    # what is said of a card, from one look at it
    own = lambda said: ended(F.concat(F.array(text("  Card ", number, " (", F.col("label"), ")")), bullet(F.col(said))))
    wrong, twice, odd = F.size("errors") > 0, F.col("duplicate_of").isNotNull(), F.col("valid") & (F.size("warnings") > 0)
    rows = inlined(
        validated, F.when(wrong, piece(2, own("errors"), F.col("number"))), F.when(odd, piece(5, own("warnings"), F.col("number"))),
        F.when(twice, piece(3, text("  Card ", number, " is a duplicate of card ", F.col("duplicate_of").cast("string"), " (", F.col("label"), ")\n"), F.col("number"))),
    )
    again = question_groups(validated).select("deck_id", *at(4, F.col("first")), text("  Cards ", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ", "), " (", F.col("label"), ")\n").alias("piece"))
    pieces = rows.unionByName(again)
    # what is said of a deck: titles, with an empty line before each section but the first, and the summary
    counts = validated.groupBy("deck_id").agg(
        F.count("*").alias("a"), F.count_if("valid").alias("b"), F.count_if(wrong).alias("c"), F.count_if(twice).alias("d"), F.count_if(F.col("question_group") < F.col("number")).alias("e"),
        F.count_if(F.col("question_group") == F.col("number")).alias("groups"), F.count_if(odd).alias("said"),
    )
    for i, (d, label) in enumerate(((dist, "Before shuffling: " if after is not None else ""), (after, "After shuffling: "))):
        if d is not None:
            doubts = d.where(F.size("warnings") > 0)
            pieces = pieces.unionByName(doubts.select("deck_id", *at(5, (1 << 31) - 3 + i), ended(prefixed(F.col("warnings"), f"  - {label}")).alias("piece")))
            counts = counts.join(doubts.select("deck_id", F.lit(1).alias(f"doubts{i}")), "deck_id", "left").withColumn("said", F.col("said") + F.coalesce(F.col(f"doubts{i}"), F.lit(0))).drop(f"doubts{i}")
    title = lambda n, section, *parts: F.when(F.col(n) > 0, piece(section, text("\n", *parts, "\n")))
    of = lambda n: F.col(n).cast("string")
    labels = (("Total cards:         ", "a"), ("Valid cards:         ", "b"), ("Invalid cards:       ", "c"), ("Duplicate cards:     ", "d"), ("Duplicate questions: ", "e"))
    summary = piece(6, text("\nSUMMARY\n", F.concat_ws("\n", *(text(f"  {label}", of(c)) for label, c in labels)), "\n"))
    totals = inlined(
        counts, title("c", 2, "INVALID CARDS (", of("c"), ") - not exported:"), title("d", 3, "DUPLICATE CARDS (", of("d"), ") - not exported:"),
        title("groups", 4, "DUPLICATE QUESTIONS (", of("groups"), " group(s)) - exported, please review:"), title("said", 5, "WARNINGS:"), summary,
    )
    opening = text("Flashcard validation report for ", F.col("deck_id"), " (parsed as ", F.col("format"), ")\n")
    notes = text("\n", F.array_join(F.transform("notes", lambda x: F.concat(F.lit("Note: "), x)), "\n"), "\n")
    pieces = pieces.unionByName(totals).unionByName(inlined(decks, piece(0, opening), F.when(F.size("notes") > 0, piece(1, notes))))
    labels = ("Correct answer distribution (as generated):" if after is not None else "Correct answer distribution:", f"Correct answer distribution (after --shuffle-options, seed {seed}):")
    for i, (d, label) in enumerate(zip((dist, after), labels, strict=True)):
        if d is not None:
            pieces = pieces.unionByName(distribution_lines(d.where("total > 0")).select("deck_id", *at(7 + i), text(f"\n{label}\n", F.col("lines"), "\n").alias("piece")))
    return pieces


def write_templates(folder: str | Path) -> list[Path]:
    """Writes the card templates; equal content each time."""
    folder = Path(folder)
    try:
        folder.mkdir(parents=True, exist_ok=True)
    except OSError as error:
        raise C.InputError(f"Could not create {folder}: {error.strerror or error}") from None
    for name, content in TEMPLATES.items():
        write_text(folder / name, content)
    return [folder / name for name in TEMPLATES]


def write_package(rows: DataFrame, path: str | Path, deck_name: str, tags: list[str] | None = None) -> None:
    """An Anki package of one deck's rows; needs the optional ``genanki``."""
    try:
        import genanki
    except ImportError:
        raise C.InputError("--apkg needs the 'genanki' package, which is not installed.\nInstall it with:\n    pip install genanki\n(The TSV file was still written and can be imported into Anki directly.)") from None
    spark = rows.sparkSession
    ids = package_ids(spark.createDataFrame([(deck_name,)], "name string"), "name").first()
    model = genanki.Model(
        ids["model_number"], C.NOTE_TYPE, fields=[{"name": c} for c in C.EXPORT_COLUMNS], templates=[{"name": "Multiple Choice", "qfmt": FRONT, "afmt": BACK}], css=STYLE
    )
    deck = genanki.Deck(ids["deck_number"], deck_name)
    from ..operators.cards import package_fields

    options = [f"Option{x}" for x in C.LETTERS]
    raw = rows.withColumns({f"_{c}": F.col(c) for c in ("Question", *options)})
    for r in package_fields(raw).orderBy("number").toLocalIterator():
        guid = genanki.guid_for(r["_Question"], *sorted(r[f"_{o}"] for o in options))
        deck.add_note(genanki.Note(model=model, fields=[r[c] for c in C.EXPORT_COLUMNS], guid=guid, tags=tags or []))
    try:
        genanki.Package(deck).write_to_file(str(path))
    except OSError as error:
        raise C.InputError(f"Could not write {path}: {error.strerror or error}") from None
