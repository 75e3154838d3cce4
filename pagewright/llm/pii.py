"""Personal data replaced by surrogates, in DataFrame functions only.

Entities are found by one regular expression over the whole text: mail addresses, phone numbers, IPv4 addresses, card
and account numbers, social security numbers, IBANs, and names of persons after a form of address or a known given
name.  A name that a text has introduced is also found there when it stands alone, and in capitals; given name and surname
together in small letters too.  Each distinct entity gets a surrogate
from a keyed hash of its canonical form, so one entity has one surrogate in all documents (coreference), however it is
written.  The surrogate has the entity's type and format: digits stay digits at their places with the separators between
them, a country code stays, a valid check digit stays valid, letters keep their case and script, octets stay octets of as
many digits, and given names keep script and gender.  A given name's gender is that of the name lists, else of the forms
of address that all texts use with it, else open.

A surrogate must not be another entity's surrogate, nor an entity that occurs.  All entities' surrogates are checked
against both, and those that collide are drawn again with the next number until none does.  Later draws have longer hosts,
phone numbers and names, so those never run out.  Should a format of fixed width be used up, as there are more entities
than it has numbers, the rest get a mark of type and hash each: distinct, and telling nothing, but not in the format.

Texts are read once for their entities; only those that have any are joined with their surrogates.

Defined cases: null texts stay null and have no entities; texts without entities come back unchanged; equal rows get
equal results; rows that repeat a doc_id, or have none, are rows of their own; an empty table gives an empty result; the
text and mentions are put in place of columns of these names, and other columns are left alone; ``key`` is a secret
parameter, and another key gives other surrogates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, partitions, prepare, some_of, text_of, unused, written

KEY = "surrogates-1"
#: After so many draws addresses may have octets of any width, and phone numbers more digits; after the last, a format has
#: no surrogate left, and the rest get marks by type and hash.
WIDE, LONGER, ROUNDS = 6, 2, 40
#: Forms of address, and given names by gender and script.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "госпожа", "г-жа", "κυρία")
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н", "κύριος")
OTHER_TITLES = ("Dr", "Prof", "Mx")
GIVEN = {
    "f_latin": ("Alice", "Anna", "Carmen", "Claire", "Elena", "Emma", "Greta", "Helen", "Ines", "Julia", "Karin", "Laura", "Lucia", "Maria", "Nora", "Olivia", "Paula", "Sarah", "Sofia", "Ursula"),
    "m_latin": ("Albert", "Bruno", "Carlos", "Daniel", "David", "Erik", "Felix", "George", "Hans", "Hugo", "James", "John", "Karl", "Louis", "Lukas", "Martin", "Oscar", "Pablo", "Peter", "Thomas"),
    "f_cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"),
    "m_cyrillic": ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Кирилл", "Максим", "Николай", "Пётр", "Сергей"),
    "f_greek": ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    "m_greek": ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Στέλιος"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fer", "gol", "han", "ker", "lin", "mor", "nel", "pas", "rin", "sol", "tan", "ver", "wel", "zor"),
    "cyrillic": ("ба", "вол", "гор", "дан", "зор", "кол", "лен", "мор", "нов", "пет", "рин", "сав", "тар", "фед", "чер", "шин"),
    "greek": ("βα", "γιλ", "δαν", "ζορ", "θελ", "καλ", "λιν", "μορ", "νελ", "παν", "ριν", "σολ", "ταν", "φελ", "χαρ", "ψιν"),
}
TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=lambda t: (-len(t), t)))
NAME, CAPITALS = r"\p{Lu}\p{Ll}{1,30}", r"\p{Lu}{2,31}"
CAPITAL_TITLES = "|".join(t.upper() for t in TITLES.split("|"))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.? {NAME}(?: {NAME})?|(?:{'|'.join(x for names in GIVEN.values() for x in names)}) {NAME}"
    rf"|(?:{CAPITAL_TITLES})\. {CAPITALS}(?: {CAPITALS})?|(?:{'|'.join(x.upper() for names in GIVEN.values() for x in names)}) {CAPITALS})(?![\p{{L}}\p{{N}}])",
}
#: All patterns: a letter is looked at only where a word starts, a name only where its first letter can be one.
ANY = (
    rf"(?<![\p{{L}}\p{{N}}])(?:{PATTERNS['email']}|{PATTERNS['iban']})|(?=[0-9+(])(?:{PATTERNS['card']}|{PATTERNS['ip']}|{PATTERNS['ssn']}|{PATTERNS['phone']})"
    rf"|(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}гκ])(?:{PATTERNS['name']})"
)
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")


def kind_of(mention: Column) -> Column:
    """The type of a mention, by its own shape."""
    return reduce(lambda out, k: out.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), ("iban", "card", "ip", "ssn", "phone", "name"), F.when(F.contains(mention, F.lit("@")), F.lit("email"))).otherwise("name")


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


#: A form of address at the start of a mention.
TITLE = rf"^(?:(?:{TITLES})\.?|(?:{CAPITAL_TITLES})\.) "


def names_in(mention: Column) -> Column:
    """The words of a name without its form of address."""
    return F.split(F.regexp_replace(mention, TITLE, ""), " ")


def gender_of(mention: Column) -> Column:
    """The gender that a form of address tells; null if none does."""
    title = lambda titles: mention.rlike(rf"^(?:(?:{'|'.join(titles)})\.?|(?:{'|'.join(t.upper() for t in titles)})\.) ")
    return F.when(title(FEMALE_TITLES), "f").when(title(MALE_TITLES), "m")


def listed_gender(form: Column) -> Column:
    listed = lambda gender: form.isin(*(n.lower() for k, names in GIVEN.items() if k[0] == gender for n in names))
    return F.when(listed("f"), "f").when(listed("m"), "m")


def parts_of(mention: Column) -> Column:
    """The entities of a mention: type, canonical form, and gender if it is told.  A name's given name and surname are two."""
    kind, digits = kind_of(mention), F.regexp_replace(mention, "[^0-9]", "")
    entity = lambda k, v, g=None: F.struct(k.alias("kind"), v.alias("form"), F.lit(g).cast("string").alias("gender") if g is None else g.alias("gender"))
    words = names_in(mention)
    surname = entity(F.concat(F.lit("surname_"), script_of(mention)), F.lower(F.element_at(words, -1)))
    given = entity(F.concat(F.lit("given_"), script_of(mention)), F.lower(F.element_at(words, 1)), gender_of(mention))
    return (
        F.when(kind == "email", F.array(entity(kind, F.lower(mention))))
        .when(kind == "ip", F.array(entity(kind, mention)))
        .when(kind == "iban", F.array(entity(kind, F.regexp_replace(mention, " ", ""))))
        .when(kind == "phone", F.array(entity(kind, F.concat(F.when(F.startswith(mention, F.lit("+")), F.concat(F.regexp_extract(mention, "^[+]([0-9]{1,3})(?:[ .(-]|$)", 1), F.lit("+"))).otherwise(F.lit("")), digits))))
        .when(kind == "name", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname)))
        .otherwise(F.array(entity(kind, digits)))
    )


def hexes(key: str, kind: Column, form: Column, draw: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, form, draw.cast("string"), F.lit(salt)), 256)


def number(hexed: Column, at: int | Column, digits: int = 6) -> Column:
    """A number from hexadecimal digits."""
    return F.conv(F.substring(hexed, at, digits) if isinstance(at, int) else F.substr(hexed, at, F.lit(digits)), 16, 10).cast("long")


def redrawn(form: Column, stream: Column, kept: Column | int = 0) -> Column:
    """The form with each digit and ASCII letter after the first ``kept`` characters drawn anew from the stream."""
    kept = F.lit(kept) if isinstance(kept, int) else kept

    def character(c: Column, i: Column) -> Column:
        draw = number(stream, i % 120 + 1, 5)
        return (
            F.when(i < kept, c).when(c.rlike("[0-9]"), (draw % 10).cast("string")).when(c.rlike("[a-z]"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw % 26 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (draw % 26 + 1).cast("int"), F.lit(1))).when(c.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), (draw % 28 + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"\p{IsGreek}"), F.substr(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), (draw % 24 + 1).cast("int"), F.lit(1))).when(c.rlike(r"\p{L}"), F.substr(F.lit("àâäçèéêëíîïñóôöùúûüß"), (draw % 20 + 1).cast("int"), F.lit(1))).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), character), "")


def luhn(digits: Column) -> Column:
    """Sum of the card check modulo 10; 0 if valid."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10


def surrogate(key: str, kind: Column, form: Column, gender: Column, draw: Column) -> Column:
    """The surrogate of a canonical form at a draw: the same type and format."""
    h = hexes(key, kind, form, draw)
    stream = F.concat(h, hexes(key, kind, form, draw, "more"))
    at = F.instr(form, "@")
    # a host of two digits, and later ones of more
    host = F.concat((number(h, 40, 6) % 9 + 1).cast("string"), F.reverse(F.lpad(number(h, 47, 12).cast("string"), 15, "0")))
    host = F.left(host, F.least(draw + 2, F.lit(12)))
    mail = F.concat(redrawn(F.left(form, at - 1), stream), F.lit("@mail"), host, F.lit(".example.org"))
    octet = lambda x, i: F.when(F.length(x) == 3, number(h, i * 6 + 1) % 156 + 100).when(F.length(x) == 2, number(h, i * 6 + 1) % 90 + 10).otherwise(number(h, i * 6 + 1) % 10)
    wide = lambda x, i: number(h, i * 6 + 1) % 256  # noqa: E731, ARG005  when those of as many digits run out
    octets = F.split(form, r"\.")
    ip = F.when(draw < WIDE, F.array_join(F.transform(octets, lambda x, i: octet(x, i).cast("string")), ".")).otherwise(F.array_join(F.transform(octets, lambda x, i: wide(x, i).cast("string")), "."))
    # a canonical phone number: its country code and a plus sign, if it has any, and all digits
    code = F.instr(form, "+")
    more = F.greatest(draw - LONGER, F.lit(0))  # later numbers are longer, 15 digits at most, and international
    longer = F.rpad(F.substr(form, code + 1), F.greatest(F.length(form) - code, F.least(F.length(form) - code + more, F.lit(15))), F.lit("0"))
    phone = F.concat(F.when((code == 0) & (more > 0), "+").otherwise(F.left(form, code)), redrawn(longer, stream, F.greatest(code - 1, F.lit(0))))
    numbers = redrawn(form, stream, 1)
    fixed = F.concat(F.left(numbers, F.length(numbers) - 1), F.lit("0"))
    card = F.when(luhn(form) == 0, F.concat(F.left(numbers, F.length(numbers) - 1), ((10 - luhn(fixed)) % 10).cast("string"))).otherwise(numbers)
    def given(script: str, genders: str) -> Column:
        names = [n.lower() for g in genders for n in GIVEN[f"{g}_{script}"]]
        return F.get(F.array(*map(F.lit, names)), (number(h, 1) % len(names)).cast("int"))

    # later draws are longer, up to twelve syllables
    sounds = lambda script, least: F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.lit(least) + draw, F.lit(12)).cast("int")), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[script])), (number(h, i * 4, 4) % 16).cast("int"))), "")
    out = F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", redrawn(form, stream)).when(kind == "iban", redrawn(form, stream, 2))
    for script in SYLLABLES:
        endings = {"latin": ("a", "o"), "cyrillic": ("а", "ий"), "greek": ("α", "ος")}[script]
        for told, genders, ending in ((gender == "f", "f", endings[0]), (gender == "m", "m", endings[1]), (gender.isNull(), "fm", "")):
            # a list's names first, then names made of syllables with the gender's ending
            out = out.when((kind == f"given_{script}") & told, F.when(draw < 3, given(script, genders)).otherwise(F.concat(sounds(script, 2), F.lit(ending))))
        out = out.when(kind == f"surname_{script}", sounds(script, 3))
    return out


def mapping(entities: DataFrame, *, key: str = KEY) -> DataFrame:
    """(kind, form, surrogate) of distinct entities (kind, form, gender), no surrogate being another's or an entity that occurs.

    In each round only entities without a surrogate draw one; those settled are written and not touched again.
    """
    spread = entities.repartition(partitions(entities), "kind", "form")  # few bytes but much work, which Spark would gather in a task
    drawing = surrogate(key, F.col("kind"), F.col("form"), F.col("gender"), F.col("draw"))
    open_ = written(spread.select("kind", "form", "gender", F.lit(0).alias("draw")).withColumn("surrogate", drawing))
    known = open_.select("kind", F.col("form").alias("surrogate"))
    settled: list[DataFrame] = []
    same = lambda a, b: (a["kind"] == b["kind"]) & (a["surrogate"] == b["surrogate"])
    for _ in range(ROUNDS):
        drawn = open_.select("kind", "surrogate").distinct()
        taken = [some_of(t.select("kind", "surrogate"), drawn, same(t, drawn), "left_semi") for t in (known, *settled)]
        free = open_.join(reduce(DataFrame.unionAll, taken).distinct(), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        settled.append(written(first.select("kind", "form", "surrogate")))
        left = open_.join(settled[-1].select("kind", "form"), ["kind", "form"], "left_anti")
        open_ = written(left.select("kind", "form", "gender", (F.col("draw") + 1).alias("draw")).withColumn("surrogate", drawing))
        if open_.isEmpty():
            break
    mark = F.concat_ws("-", F.regexp_extract("kind", "^[a-z]+", 0), F.left(hexes(key, F.col("kind"), F.col("form"), F.col("draw")), F.lit(24)))
    return reduce(DataFrame.unionAll, [*settled, open_.select("kind", "form", mark.alias("surrogate"))])


def laid_out(mention: Column, signs: Column, inside: str) -> Column:
    """The mention with its characters of a class replaced, in order, by those of ``signs``."""
    step = lambda a, c: F.when(c.rlike(inside), F.struct(F.concat(a["out"], F.substr(signs, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    return F.aggregate(F.filter(F.split(mention, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda a: a["out"])


def written_as(mention: Column, held: Column) -> Column:
    """A mention's surrogate as it is written in the text; ``held`` maps type and form to surrogates."""
    kind, parts = kind_of(mention), parts_of(mention)
    of = lambda part: F.try_element_at(held, F.concat(part["kind"], F.lit(":"), part["form"]))
    first = of(F.element_at(parts, 1))
    cased = lambda x, like: F.when(like == F.upper(like), F.upper(x)).otherwise(x)
    title = F.regexp_extract(mention, TITLE, 0)
    own = F.element_at(names_in(mention), -1)
    named = lambda x: F.when((F.length(own) > 1) & (own == F.upper(own)), F.upper(x)).when(own == F.lower(own), x).otherwise(F.initcap(x))
    # a name that stands alone is a surname, else a given name
    alone = F.try_element_at(held, F.concat(F.lit("given_"), script_of(mention), F.lit(":"), F.lower(mention)))
    name = F.concat(title, F.array_join(F.transform(parts, lambda p: named(F.coalesce(of(p), alone))), " "))
    digits = F.regexp_replace(first, "^[0-9]*[+]", "")
    fits = F.length(digits) == F.length(F.regexp_replace(mention, "[^0-9]", ""))
    # a longer number: its country code, if it has one, then the rest
    code = F.regexp_extract(first, "^([0-9]+)[+]", 1)
    longer = F.when(~F.contains(first, F.lit("+")), first).when(code == "", first).otherwise(F.concat(F.lit("+"), code, F.lit(" "), F.substr(digits, F.length(code) + 1)))
    numbered = F.when(fits, laid_out(mention, digits, "[0-9]")).otherwise(longer)
    letters = F.when(F.length(first) == F.length(F.regexp_replace(mention, " ", "")), laid_out(mention, first, "[A-Z0-9]")).otherwise(first)
    return F.when(kind == "email", cased(first, mention)).when(kind == "ip", first).when(kind == "iban", letters).when(kind == "name", name).otherwise(numbered)


def pattern_of(held: Column) -> Column:
    """The expression, with the names of a text as far as they are no part of it.

    Names that stand alone are found with a capital letter or in capitals, given name and surname together in small letters too.
    """
    of = lambda kind: F.transform(F.filter(F.map_keys(held), lambda k: k.rlike(f"^{kind}_")), lambda k: F.substring_index(k, ":", -1))
    names = F.concat(of("surname"), of("given"))
    words = F.array_join(F.array_distinct(F.concat(F.transform(names, F.initcap), F.transform(names, F.upper))), "|")
    pair = F.when((F.size(of("given")) > 0) & (F.size(of("surname")) > 0), F.concat(F.lit("|(?:"), F.array_join(of("given"), "|"), F.lit(") (?:"), F.array_join(of("surname"), "|"), F.lit(")"))).otherwise(F.lit(""))
    return F.when(words == "", F.lit(ANY)).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), words, pair, F.lit(r")(?![\p{L}\p{N}])")))


def with_surrogates(documents: DataFrame, *, key: str = KEY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with surrogates in the text, and mentions: the types in order, in place of a column of this name."""
    prepare(documents.sparkSession)
    own, no, yes, map_, pattern, mentions = unused(documents, "__row", "__no", "__yes", "__held", "__pattern", "__found")
    row = F.xxhash64(F.col(id_column).cast("long"), F.col(text).cast("string"))
    found = documents.select(row.alias(own), F.regexp_extract_all(text_of(text), F.lit(ANY), F.lit(0)).alias("found")).where(F.size("found") > 0)
    parts = written(found.select(own, F.explode(F.array_distinct("found")).alias("mention")).select(own, F.explode(parts_of(F.col("mention"))).alias("p")).select(own, "p.*").distinct())
    told = parts.groupBy("kind", "form").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    gender = F.when(F.startswith("kind", F.lit("given")), F.coalesce(listed_gender(F.col("form")), F.when(F.col("low") == F.col("high"), F.col("low"))))
    names = written(mapping(told.select("kind", "form", gender.alias("gender")), key=key))
    entry = F.struct(F.concat("kind", F.lit(":"), "form").alias("k"), F.col("surrogate").alias("v"))
    held = written(parts.join(names, ["kind", "form"]).groupBy(own).agg(F.map_from_entries(F.collect_set(entry)).alias(map_)))
    rows = held.select(own)
    new = {text: F.array_join(F.zip_with(F.split(text, F.col(pattern), -1), F.concat(F.transform(mentions, lambda m: written_as(m, F.col(map_))), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""), "mentions": F.transform(mentions, kind_of)}
    old = {text: F.col(text), "mentions": F.array().cast("array<string>")}
    shown = lambda df, made: df.select(*(F.col(c) for c in documents.columns if c not in made), *(v.alias(k) for k, v in made.items()))
    keyed = documents.withColumn(own, row)
    if held.count() <= BROADCAST_IDS:  # then only texts with entities are shuffled
        without = documents.join(F.broadcast(rows.withColumnRenamed(own, no)), row == F.col(no), "left_anti")
        keyed = some_of(keyed, rows.withColumnRenamed(own, yes), F.col(own) == F.col(yes), "left_semi")
        joined = keyed.join(held, own)
    else:
        joined = keyed.join(held.hint("shuffle_hash"), own, "left")
        without = joined.where(F.col(map_).isNull())
        joined = joined.where(F.col(map_).isNotNull())
    joined = joined.withColumn(pattern, pattern_of(F.col(map_))).withColumn(mentions, F.regexp_extract_all(text, F.col(pattern), F.lit(0)))
    return shown(without, old).unionAll(shown(joined, new))


def report(found: DataFrame) -> DataFrame:
    """Mentions by type, and the text with surrogates."""
    of = lambda kind: F.size(F.filter("mentions", lambda m: m == kind)).cast("long")
    return found.select("doc_id", F.size("mentions").cast("long").alias("n_entities"), *(of(k).alias(f"n_{k}") for k in KINDS), F.coalesce("text", F.lit("")).alias("text"))
