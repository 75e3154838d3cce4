"""Validating cards, finding duplicates, statistics of answers, and export rows.

Cards are rows as ``sources.decks`` makes them: deck_id, number, py_type, label, keys, question, answer, explanation,
options.  Each error and warning has a stable code beside its message.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fixed_udf, line_breaks, percent, stable_id, without_space
from .draws import drawn_options

MESSAGES = "array<struct<code:string,message:string>>"


def letters() -> Column:
    return F.array(*map(F.lit, C.LETTERS))


def message(code: str, *parts: str | Column) -> Column:
    """A coded message of literal texts and columns."""
    return F.struct(F.lit(code).alias("code"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("message"))


def some(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(condition, m) for condition, m in pairs)))


def nothing() -> Column:
    return F.array().cast(MESSAGES)


def is_text(field: Column) -> Column:
    return F.coalesce(field["py_type"] == "str", F.lit(False))


def blank(field: Column) -> Column:
    return without_space(field["value"]) == ""


def field_errors(name: str) -> Column:
    """The first thing wrong with a required text field."""
    f = F.col(name)
    return some((
        ~is_text(f) | blank(f) | (f["visible"] == ""),
        F.when(~is_text(f), message("type", f"'{name}' must be a string, got ", f["py_type"])).when(blank(f), message("empty", f"'{name}' is empty"))
        .otherwise(message("html_only", f"'{name}' contains only HTML/whitespace and would display as blank: ", f["repr"])),
    ))


def field_ok(name: str) -> Column:
    return is_text(F.col(name)) & (F.coalesce(F.col(name)["visible"], F.lit("")) != "") & ~F.coalesce(blank(F.col(name)), F.lit(True))


def with_errors(cards: DataFrame) -> DataFrame:
    """Adds errors: everything that keeps a card from being exported, in the order of checking."""
    names = F.transform("keys", lambda k: k["name"])
    missing = F.filter(F.array(*map(F.lit, C.REQUIRED)), lambda k: ~F.coalesce(F.array_contains(names, k), F.lit(False)))
    known = F.array(*map(F.lit, (*C.REQUIRED, *C.OPTIONAL)))
    unexpected = F.filter("keys", lambda k: k["name"].isNull() | ~F.array_contains(known, k["name"]))
    key_errors = F.concat(
        F.transform(missing, lambda k: message("missing_key", "missing required key '", k, "'")),
        F.transform(unexpected, lambda k: message("unexpected_key", "unexpected key ", k["repr"], F.when(k["hint"].isNotNull(), F.concat(F.lit(" (did you mean '"), k["hint"], F.lit("'?)"))).otherwise(F.lit("")))),
    )
    items, letter = F.col("options.items"), lambda i: F.get(letters(), i)
    listed, four = F.col("options.py_type") == "list", F.size("options.items") == 4
    seen = lambda o: is_text(o) & (F.coalesce(o["visible"], F.lit("")) != "")
    item_errors = F.array_compact(F.transform(items, lambda o, i: F.when(~is_text(o), message("option_type", "option ", letter(i), " must be a string, got ", o["py_type"])).when(~seen(o), message("option_empty", "option ", letter(i), " is empty"))))
    norms = F.transform(items, lambda o: o["norm"])
    first = lambda o: (F.array_position(norms, o["norm"]) - 1).cast("int")
    twins = F.array_compact(F.transform(items, lambda o, i: F.when(first(o) < i, message(
        "option_twin", "option ", letter(i), " is ", F.when(o["value"] == F.get(items, first(o))["value"], "identical to").otherwise("effectively identical to (ignoring case/spacing/HTML)"),
        " option ", letter(first(o)), ": ", o["shown"],
    ))))
    solid = listed & four & (F.size(item_errors) == 0)
    option_errors = (
        F.when(~listed, F.array(message("options_type", "'options' must be a list, got ", F.col("options.py_type"))))
        .when(~four, F.array(message("options_count", "'options' must contain exactly 4 items, found ", F.size("options.items").cast("string"))))
        .when(~solid, item_errors)
        .otherwise(twins)
    )
    answer = F.col("answer")
    near = (F.array_position(norms, answer["norm"]) - 1).cast("int")
    fits = F.array_contains(F.transform(items, lambda o: o["value"]), answer["value"])
    membership = some((
        ~fits,
        F.when(near >= 0, message("answer_near", "'answer' does not exactly match any option; it matches option ", letter(near), " only when ignoring case/spacing/HTML. Edit the card so the text is identical."))
        .otherwise(message("answer_absent", "'answer' does not match any of the 4 options (answer: ", answer["shown"], ")")),
    ))
    placeholders = [F.lit(p) for p in C.PLACEHOLDERS]
    explained = F.array_contains(names, "explanation") & ~is_text(F.col("explanation"))
    contents = F.concat(
        field_errors("question"), field_errors("answer"),
        some((field_ok("question") & F.col("question.norm").isin(*placeholders), message("placeholder", "'question' looks like a placeholder: ", F.col("question.repr")))),
        some((F.coalesce(explained, F.lit(False)), message("explanation_type", "'explanation' must be a string, got ", F.col("explanation.py_type")))),
        option_errors, F.when(solid & (F.size(twins) == 0) & field_ok("answer"), membership).otherwise(nothing()),
    )
    errors = (
        F.when(F.col("py_type") != "dict", F.array(message("not_a_dict", f"expected a dictionary with keys {', '.join(C.REQUIRED)}; got ", F.col("py_type"))))
        .when(F.size(missing) > 0, key_errors)
        .otherwise(F.concat(key_errors, contents))
    )
    doubtful = (F.col("py_type") == "dict") & (F.size(missing) == 0) & field_ok("answer") & F.col("answer.norm").isin(*placeholders)
    return cards.withColumns({"errors": errors.cast(MESSAGES), "_doubtful": F.coalesce(doubtful, F.lit(False))})


def labelled_letters(options: Column) -> Column:
    """The letters of the options that start with a letter label of their own."""
    return F.array_compact(F.transform(options, lambda o, i: F.when(o.rlike(C.OPTION_LABEL), F.get(letters(), i))))


def with_warnings(cards: DataFrame) -> DataFrame:
    """Adds warnings to cards with errors: what can be exported but may not look right."""
    items = F.col("options.items")
    fields = [("question", F.col("question")), ("answer", F.col("answer")), *((f"option {x}", F.get(items, F.lit(i))) for i, x in enumerate(C.LETTERS)), ("explanation", F.col("explanation"))]
    quoted = lambda tags: F.array_join(F.transform(F.slice(tags, 1, 3), lambda t: F.when(F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"')), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))), ", ")
    tags = [(F.size(f["tags"]) > 0, message("html_tag", f"{name} contains ", quoted(f["tags"]), ", which Anki will treat as an HTML tag and hide. If it is meant literally, write &lt; instead of <.")) for name, f in fields]
    labelled = labelled_letters(F.transform(items, lambda o: o["value"]))
    label = (F.size(labelled) >= 2, message("letter_labels", "options ", F.array_join(labelled, ", "), " start with their own letter label (e.g. 'A. ...'); the Anki template already adds A-D labels."))
    sound = F.size("errors") == 0
    doubtful = F.when(F.col("_doubtful"), F.array(message("placeholder_answer", "'answer' looks like a placeholder: ", F.col("answer.repr")))).otherwise(nothing())
    return cards.withColumn("warnings", F.concat(doubtful, F.when(sound, some(*tags, label)).otherwise(nothing())).cast(MESSAGES)).drop("_doubtful")


def with_duplicates(cards: DataFrame) -> DataFrame:
    """Adds duplicate_of, the first error-free card with the same question, answer and set of options, and question_group."""
    options = F.array_sort(F.transform("options.items", lambda o: o["norm"]))
    sound = F.size("errors") == 0
    card_key = F.when(sound, F.sha2(F.to_json(F.struct(F.col("question.norm").alias("q"), F.col("answer.norm").alias("a"), options.alias("o"))), 256))
    keyed = cards.withColumn("_card", F.coalesce(card_key, F.concat_ws("#", F.lit("bad"), "number")))
    lead = F.min("number").over(Window.partitionBy("deck_id", "_card"))
    found = keyed.withColumn("duplicate_of", F.when(lead < F.col("number"), lead)).drop("_card")
    single = sound & F.col("duplicate_of").isNull()
    grouped = found.withColumn("_question", F.when(single, F.concat_ws(":", F.lit("q"), "question.norm")).otherwise(F.concat_ws("#", F.lit("bad"), "number")))
    group = Window.partitionBy("deck_id", "_question")
    first, n = F.min("number").over(group), F.count("*").over(group)
    again = message("same_question", "same question as card #", first.cast("string"), " but different answer/options. Both are exported, but Anki matches notes on the first field (Question), so on import it may update or skip one of them.")
    grouped = grouped.withColumns({"question_group": F.when(single & (n > 1), first), "warnings": F.when(single & (first < F.col("number")), F.concat("warnings", F.array(again))).otherwise(F.col("warnings"))})
    return grouped.drop("_question").withColumn("valid", single)


def validate(cards: DataFrame) -> DataFrame:
    """All cards with errors, warnings, duplicate_of, question_group and valid."""
    return checked(cards.where(F.col("number").isNotNull()))


def checked(parsed: DataFrame) -> DataFrame:
    """The same beside the rows of decks without cards, whose number is null: they pass through, and none is valid."""
    return with_duplicates(with_warnings(with_errors(parsed)))


def texts_only(validated: DataFrame) -> DataFrame:
    """Validated cards with no more of their fields than their texts, and without their keys: all that rows and reports need."""
    fields = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["value"].alias("value"))) for c in ("question", "answer", "explanation")}
    items = F.transform("options.items", lambda o: F.struct(o["value"].alias("value")))
    return validated.drop("keys").withColumns({**fields, "options": F.when(F.col("options").isNotNull(), F.struct(F.col("options.py_type").alias("py_type"), items.alias("items")))})


def question_groups(validated: DataFrame) -> DataFrame:
    """(deck_id, first, numbers, label): cards that share a question but nothing more."""
    held = validated.where(F.col("question_group").isNotNull())
    return held.groupBy("deck_id", F.col("question_group").alias("first")).agg(F.array_sort(F.collect_list("number")).alias("numbers"), F.min_by("label", "number").alias("label"))


def correct_letter(options: Column, answer: Column) -> Column:
    return F.get(letters(), (F.array_position(options, answer) - 1).cast("int"))


def shuffled(options: Column, seed: int, *keys: Column) -> Column:
    """The options in an order that depends on the seed and the card alone: that of the hashes of seed, card and place."""
    card = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    keyed = F.transform(options, lambda o, i: F.struct(F.sha2(F.concat_ws(":", card, i.cast("string")), 256).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def export_rows(validated: DataFrame, *, seed: int | None = None, drawn: bool = False) -> DataFrame:
    """(deck_id, number, the eight columns) of valid cards; with a seed the options are shuffled.

    They are shuffled card by card, or ``drawn`` from one generator in the order of each deck's valid cards.
    """
    options = F.transform("options.items", lambda o: o["value"])
    if seed is not None and not drawn:
        options = shuffled(options, seed, F.col("deck_id"), F.col("number"))
    held = validated.where("valid").select("deck_id", "number", F.col("question.value").alias("Question"), options.alias("_o"), F.col("answer.value").alias("CorrectAnswer"), F.coalesce("explanation.value", F.lit("")).alias("Explanation"))
    if seed is not None and drawn:
        held = drawn_options(held, "_o", seed)
    return held.select(
        "deck_id", "number", "Question", *(F.get("_o", F.lit(i)).alias(f"Option{x}") for i, x in enumerate(C.LETTERS)), "CorrectAnswer", correct_letter(F.col("_o"), F.col("CorrectAnswer")).alias("CorrectLetter"), "Explanation"
    ).select("deck_id", "number", *C.EXPORT_COLUMNS)


def erfc_sql(z: str) -> str:
    """The complementary error function of a column that is not negative: a series of positive terms, from 2 on a continued fraction.

    Both are written out as nested arithmetic, so no lambda comes near the formatting UDF, which Spark could not evaluate then.
    """
    series, fraction = "1D", z
    for n in range(60, 0, -1):
        series = f"(1D + {z} * {z} * {2 / (2 * n + 1)!r}D * {series})"
        fraction = f"({z} + {n / 2}D / {fraction})"
    down, root = f"exp(-{z} * {z})", f"{math.sqrt(math.pi)!r}D"
    return f"CASE WHEN {z} < 2 THEN 1 - 2 / {root} * {down} * {z} * {series} ELSE {down} / ({root} * {fraction}) END"


def chi2_tail(root: str) -> Column:
    """Probability that chi-square with three degrees of freedom exceeds x, from a column that holds the root of x / 2."""
    z = f"`{root}`"
    return F.expr(f"{erfc_sql(z)} + {2 / math.sqrt(math.pi)!r}D * {z} * exp(-{z} * {z})")


def distribution(rows: DataFrame) -> DataFrame:
    """(deck_id, A, B, C, D, total, chi2, unbalanced, most, least): where the correct answers stand in a deck's rows."""
    counts = rows.groupBy("deck_id").agg(*(F.count_if(F.col("CorrectLetter") == x).alias(x) for x in C.LETTERS), F.count("*").alias("total"))
    return with_chi2(counts)


def with_chi2(counts: DataFrame) -> DataFrame:
    expected = F.col("total") / 4
    square = lambda x: (F.col(x) - expected) * (F.col(x) - expected) / expected
    enough = F.col("total") >= C.CHI2_LEAST
    ordered = F.array(*(F.struct(F.col(x).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(C.LETTERS)))
    rising = F.array(*(F.struct(F.col(x).alias("n"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(C.LETTERS)))
    return counts.withColumn("chi2", F.when(enough, square("A") + square("B") + square("C") + square("D"))).withColumns({
        "unbalanced": F.coalesce(F.col("chi2") > C.CHI2_CRITICAL, F.lit(False)), "most": F.array_max(ordered)["x"], "least": F.array_min(rising)["x"],
    })


def distribution_warnings(dist: DataFrame) -> DataFrame:
    """Adds p_value and warnings (array of text) of a deck's distribution."""
    held = dist.withColumn("_root", F.sqrt(F.col("chi2") / 2)).withColumn("p_value", chi2_tail("_root")).drop("_root")
    count = lambda letter: F.element_at(F.create_map(*(y for x in C.LETTERS for y in (F.lit(x), F.col(x)))), letter)
    skewed = F.concat(
        F.lit("Correct-answer placement is highly unbalanced: "), F.col("most"), F.lit(" is correct "), percent(count(F.col("most")) / F.col("total")), F.lit(" of the time and "), F.col("least"), F.lit(" only "),
        percent(count(F.col("least")) / F.col("total")), F.lit(" (expected ~25% each; chance of this by luck p="), fixed_udf("p_value", F.lit(4)),
        F.lit("). Learners may pick up the pattern. Consider --shuffle-options or asking the LLM to vary the correct position."),
    )
    few = F.concat(F.lit("Only "), F.col("total").cast("string"), F.lit(" valid card(s): too few to judge whether answer placement is balanced."))
    return held.withColumn("warnings", F.array_compact(F.array(F.when(F.col("unbalanced"), skewed), F.when((F.col("total") > 0) & (F.col("total") < C.CHI2_LEAST), few))))


def deck_summary(validated: DataFrame) -> DataFrame:
    """(deck_id, total, valid, invalid, duplicates, duplicate_questions)."""
    return validated.groupBy("deck_id").agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.count_if(F.col("question_group") < F.col("number")).alias("duplicate_questions"),
    )


def strict_decks(validated: DataFrame) -> DataFrame:
    """The cards of decks in which every card is valid."""
    failing = validated.where(~F.col("valid")).select("deck_id").distinct()
    return validated.join(failing, "deck_id", "left_anti")


def package_ids(decks: DataFrame, name: str) -> DataFrame:
    """The numbers of note type and deck in a package; ``name`` is the column with the deck's name."""
    return decks.withColumns({"model_number": stable_id(F.lit(f"model:{C.NOTE_TYPE}")), "deck_number": stable_id(F.concat(F.lit("deck:"), F.col(name)))})


def package_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: line_breaks(F.col(c)) for c in C.EXPORT_COLUMNS})
