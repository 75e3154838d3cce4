"""Surrogates: nothing left, formats kept, one for one across documents."""

import re

import regex

from pagewright.llm import pii
from pagewright.llm.pii import mapping, report, with_surrogates

TEXTS = [
    (1, "Write to Ann.Lee+x@mail5.example.com or ann.lee+x@MAIL5.example.com, call +1 (499) 555-6503."),
    (2, "call +1 499 555 6503 or (212) 555-0199 from 203.0.113.77; card 4111 1111 1111 1111, 4111111111111111!!"),
    (3, "Mrs. Anna Smith met Mr. Peter Smith and Dr. Jones. Later Mrs. Smith left; Herr Müller, господин Иванов stayed."),
    (4, "no entities here: 3.14, v1.2.3, 1999-2004, 555, a@b, Licensed under version 2.0."),
    (5, None),
    (6, ""),
    (7, "UP.CASE@EXAMPLE.ORG DE89 3704 0044 0532 0130 00 123-45-6789 été.né.42@mail.example.net 4785380592391139###"),
    (8, "a@example.com\n" * 300 + "10.0.0.1 10.0.0.2"),
    (None, "x.y@example.com"),
]


def run(spark, **options):
    df = spark.createDataFrame([(d, t, "k") for d, t in TEXTS], "doc_id long, text string, mentions string")
    return {r.doc_id: r for r in with_surrogates(df, **options).collect()}


def test_formats(spark):
    rows = run(spark)
    assert len(rows) == len(TEXTS)
    before = dict(TEXTS)
    for d, r in rows.items():
        if not before[d]:
            assert r.text == before[d] and r.mentions == []
    assert rows[4].text == before[4] and rows[4].mentions == []
    one = rows[1].text
    assert rows[1].mentions == ["email", "email", "phone"]
    mails = re.findall(r"\S+@\S+?\.org", one)
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+[a-z]@mail\d\d\.example\.org", mails[0])
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert "499" not in phone or "6503" not in phone
    two = rows[2].text
    assert re.sub(r"\D", "", re.search(r"call (\+1 \d{3} \d{3} \d{4})", two)[1]) == re.sub(r"\D", "", phone)
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16})!!", two)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111"
    digits = [int(c) for c in cards[2]]
    assert sum(digits[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in digits[-2::-2]) != 1 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in digits[-2::-2])) % 10 == 0
    assert re.search(r"from \d{3}\.\d\.\d{3}\.\d{2};", two) and "203.0.113.77" not in two
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+) and Dr\. (\w+)\. Later Mrs\. (\w+) left; Herr (\w+), господин (\w+) stayed\.", rows[3].text)
    assert names[2] == names[4] == names[6] != "Smith" and names[1] in pii.GIVEN["f_latin"] and names[3] in pii.GIVEN["m_latin"]
    assert re.fullmatch("[А-Яа-яё]+", names[8]) and len({names[2], names[5], names[7]}) == 3
    seven = rows[7].text
    assert re.match(r"[A-Z]{2}\.[A-Z]{4}@MAIL\d\d\.EXAMPLE\.ORG DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d \d{3}-\d\d-\d{4} \S+@mail\d\d\.example\.org 4\d{15}###$", seven)
    for d, r in rows.items():
        for secret in ("Lee", "6503", "0199", "Smith", "Jones", "Müller", "Иванов", "CASE", "0532", "6789", "né.42", "92391139", "x.y@"):
            assert secret not in (r.text or ""), (d, secret)
    assert len(set(re.findall(r"\S+@\S+", rows[8].text))) == 1 and len(rows[8].mentions) == 302


def test_key(spark):
    assert run(spark)[1].text == run(spark)[1].text != run(spark, key="other")[1].text


def test_collisions(spark):
    """A small space of addresses: all surrogates are distinct and none is an entity."""
    forms = [("ip", f"{a}.{b}.{c}.{d}") for a in (1, 2, 3) for b in range(10) for c in range(10) for d in range(10)]
    forms += [("given_latin", f"name{i}") for i in range(60)] + [("given_latin", n.lower()) for n in pii.GIVEN["f_latin"]]
    rows = mapping(spark.createDataFrame([(*f, "f") for f in forms], "kind string, form string, gender string")).collect()
    assert len(rows) == len(forms) == len({(r.kind, r.surrogate) for r in rows})
    assert not {(r.kind, r.surrogate) for r in rows} & set(forms)


def test_one_person_has_one_name(spark):
    """Neutral titles, lone names, and a name whose gender only a title in another text tells."""
    texts = [
        (1, "Dr. Anna Smith came. Anna Smith left; Smithson and Susanna stayed. Later Smith said so, and Anna's dog with Mrs. Smith."),
        (2, "Smith is not introduced here."),
        (None, "Mrs. Robin Hill."),
        (None, "Dr. Robin Hill and Prof. Kim Vale; Kim, Robin."),
    ]
    rows = [r.text for r in with_surrogates(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    one = next(regex.fullmatch(r"Dr\. (\w+) (\w+) came\. (\w+) (\w+) left; Smithson and Susanna stayed\. Later (\w+) said so, and (\w+)'s dog with Mrs\. (\w+)\.", r) for r in rows if "Smithson" in r)
    assert one[1] == one[3] == one[6] in pii.GIVEN["f_latin"] and one[2] == one[4] == one[5] == one[7] != "Smith"
    assert "Smith is not introduced here." in rows
    robin = next(regex.fullmatch(r"Mrs\. (\w+) (\w+)\.", r) for r in rows if r.startswith("Mrs"))
    two = next(regex.fullmatch(r"Dr\. (\w+) (\w+) and Prof\. (\w+) (\w+); (\w+), (\w+)\.", r) for r in rows if "Prof" in r)
    assert robin[1] == two[1] == two[6] in pii.GIVEN["f_latin"] and robin[2] == two[2] and two[3] == two[5] != "Kim"


def test_names_in_other_letters(spark):
    texts = [(1, "Mr. John Smith and JOHN SMITH; a smith, john smith, SMITH's. MRS. ANNA BELL, ANNA BELL and Anna."), (2, "DR NO has no DOT, JOHN does not. PETER ROW.")]
    one, two = (r.text for r in with_surrogates(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect())
    m = regex.fullmatch(r"Mr\. (\w+) (\w+) and (\w+) (\w+); a smith, (\w+) (\w+), (\w+)'s\. MRS\. (\w+) (\w+), (\w+) (\w+) and (\w+)\.", one)
    given, surname = m[1], m[2]
    assert given in pii.GIVEN["m_latin"] and (m[3], m[4], m[5], m[6], m[7]) == (given.upper(), surname.upper(), given.lower(), surname.lower(), surname.upper())
    assert m[8] == m[10] == m[12].upper() != "ANNA" and m[9] == m[11] == m[9].upper() != "BELL" and m[12] in pii.GIVEN["f_latin"]
    assert regex.fullmatch(r"DR NO has no DOT, JOHN does not\. (?!PETER ROW)\p{Lu}+ \p{Lu}+\.", two)


def test_small_formats_do_not_run_out(spark):
    """All short phone numbers that there are, thousands of one-digit addresses, and more entities than a format can hold."""
    phones = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(10_000)]
    mails = [f"1@d{i}.com" for i in range(5_000)]
    rows = with_surrogates(spark.createDataFrame([(i, f"call {p} or {mails[i % 5_000]}") for i, p in enumerate(phones)], "doc_id long, text string")).collect()
    phone, mail = {}, {}
    for r in rows:
        m = regex.fullmatch(rf"call ({pii.PATTERNS['phone']}) or ({pii.PATTERNS['email']})", r.text)
        assert m and r.mentions == ["phone", "email"] and regex.fullmatch(r"\+1 \d+( \d+)?", m[1]) and regex.fullmatch(r"\d@mail\d+\.example\.org", m[2]), r.text
        assert mail.setdefault(r.doc_id % 5_000, m[2]) == m[2]
        phone[r.doc_id] = regex.sub(" ", "", m[1])
    assert len(set(phone.values())) == 10_000 and not set(phone.values()) & {regex.sub(" ", "", p) for p in phones}
    assert len(set(mail.values())) == 5_000


def test_a_format_that_is_used_up(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 3)
    forms = [("card", f"{i}") for i in range(10)]  # one digit, and the check digit: nothing is free
    rows = mapping(spark.createDataFrame([(*f, None) for f in forms], "kind string, form string, gender string")).collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 10 and not {r.surrogate for r in rows} & {f for _, f in forms}
    assert all(re.fullmatch("card-[0-9a-f]{24}", r.surrogate) for r in rows)


def test_tables_by_a_plain_detector(spark):
    """Each kind searched by itself, the earliest taken; then one surrogate an entity, and nothing else changed."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionAll(spark.createDataFrame([(9000 + (d or 0), t, "", "", 0) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars int"))
    kinds = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    to, back, found = {}, {}, 0

    def entities(text):
        at = 0
        while best := min(((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) if (m := p.search(text, at))), default=None):
            yield best[0], best[2], best[3]
            at = best[2]

    rows = {r.doc_id: r for r in with_surrogates(df).collect()}
    for before in df.collect():
        text, r = before.text or "", rows[before.doc_id]
        held = [regex.sub(pii.TITLE, "", text[a:b]).lower().split() for a, b, k in entities(text) if k == "name"]
        names = {x for words in held for w in words for x in (w.capitalize(), w.upper())} | {f"{g[0]} {n[-1]}" for g in held if len(g) > 1 for n in held}
        lone = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(names)})(?![\p{{L}}\p{{N}}])") if names else None
        spans, at = [], 0
        for a, b, k in [*entities(text), (len(text), len(text), None)]:
            spans += [(m.start(), m.end(), "name") for m in lone.finditer(text, at, a)] if lone else []
            spans += [(a, b, k)] if k else []
            at = b
        assert r.mentions == [k for _, _, k in spans], before.doc_id
        found += len(spans)
        # the text between entities is the same, in order; what stands for an entity is always the same
        pieces, at = [], 0
        for a, b, k in spans:
            pieces += [regex.escape(text[at:a]), "(.+?)" if k == "name" else f"({pii.PATTERNS[k]})"]
            at = b
        whole = regex.fullmatch("".join([*pieces, regex.escape(text[at:])]), r.text or "", regex.S)
        assert whole, before.doc_id
        for (a, b, k), new in zip(spans, whole.groups(), strict=True):
            if k != "name":
                form = (k, regex.sub("[^0-9A-Za-z.@_%+-]" if k == "email" else r"[^0-9A-Z.]" if k in ("ip", "iban") else "[^0-9]", "", text[a:b]).lower())
                fresh = (k, regex.sub("[^0-9A-Za-z.@_%+-]" if k == "email" else r"[^0-9A-Z.]" if k in ("ip", "iban") else "[^0-9]", "", new).lower())
                assert kinds[k].fullmatch(new) and to.setdefault(form, fresh) == fresh != form and back.setdefault(fresh, form) == form
    assert found > 30


def test_empty(spark):
    assert report(with_surrogates(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
