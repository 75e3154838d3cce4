"""Main text of pages: planted pages, and the table's pages against their source structure."""

import re
import time

import pyarrow.parquet as pq

from pagewright.llm.html_text import Lines, chosen, extract, lines_of, main_text, smoothed, two_means

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  para\n graph.<br><p>Second &lt;para&gt; &copy; with <a href='/x'>a link</a> in it, long enough to be content.</p><p>De.</p></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p{{margin:0}}</style><script>var t="</p>";track(5);</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now, a long advert text that is as long as a paragraph of the article is.</div>
<div id="cookie-notice">We use cookies</div>{ARTICLE}<aside><p>Related reading about other things in this sidebar.</p></aside><section class="comments"><article><p>I do not agree with this article at all, said a reader.</p></article></section>
<form><label>Name</label><input name=q><textarea>words</textarea></form><footer>&copy; site &middot; Some words of the footer.</footer></body></html>"""
TEXT = "Title & more\nFirst para graph.\nSecond <para> © with a link in it, long enough to be content.\nDe."


def test_planted_page():
    assert main_text(PAGE) == TEXT
    assert main_text(PAGE[: PAGE.index("</article>")]) == TEXT  # cut off
    assert main_text(PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")) == TEXT
    assert main_text(f"<nav>x</nav><main>{ARTICLE}</main>") == TEXT


def test_bare_page():
    paragraphs = "".join(f"<p>Paragraph {i} has a fair number of words, as the text of a page has, and no links at all.</p>" for i in range(6))
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(12))
    text = main_text(f"<body>{links}{paragraphs.replace('Paragraph 3 has a fair number of words, as the text of a page has, and no links at all.', 'Short.')}{links}</body>")
    assert "Short." in text and text.startswith("Paragraph 0") and text.endswith("no links at all.") and "Link" not in text


def test_without_marks():
    """Headline and short paragraphs stay where no article is marked; unmarked links and a notice in a box go."""
    body = "".join(f"<p>{'Sentence of a paragraph that goes on for a while. ' * (i % 3 + 2)}</p>" for i in range(5))
    text = ["Headline", "Short start."] + [" ".join(["Sentence of a paragraph that goes on for a while."] * (i % 3 + 2)) for i in range(5)] + ["Point.", "End."]
    page = f'<body><div class="x1"><a href="/">Home</a> <a href="/n">News</a></div><div><p>We keep cookies.</p></div><div class="x2"><h1>Headline</h1><p>Short start.</p>{body}<ul><li>Point.</ul><p>End.</div><div><a href="/o">Other page</a></div></body>'
    assert main_text(page).split("\n") == text
    assert main_text(page.replace('<div class="x2">', "").replace("End.</div>", "End.")).split("\n") == text
    assert main_text(page.replace("Point.", "Point.<br><p>In the point").replace("End.", 'End. <a href="/m">More</a>')).split("\n") == text[:-1] + ["In the point", "End. More"]


def test_articles():
    part = lambda i: f"<article><h2>Part {i}</h2><p>{'Words of this part of the page. ' * 9}</p><p>Last.</p></article>"
    expected = [x for i in range(2) for x in (f"Part {i}", ("Words of this part of the page. " * 9).strip(), "Last.")]
    assert main_text(f"<main><h1>Above</h1>{part(0)}<p>no part</p>{part(1)}</main><footer>f</footer>").split("\n") == ["Above", *expected]
    assert main_text(f"<header><h1>Site</h1></header>{part(0)}{part(1)}").split("\n") == expected
    inside = ARTICLE.replace("<p>De.</p>", '<div class="related-work"><p>On other work.</p></div><div class="related-posts"><p>More posts</p></div><div id="comments"><p>A reader.</p></div><p class="notice-of-intent">De.</p>')
    assert main_text(PAGE.replace(ARTICLE, inside)) == TEXT.replace("De.", "On other work.\nDe.")


def test_the_threshold_decides():
    box = "<div><p>Tiny.</p><p>Bits.</p></div>"
    rest = "<div>" + "<p>A paragraph that is a good deal longer than all of the others on this page.</p>" * 3 + "</div>"
    parser = lines_of(f"{box}<div><a href=x>one</a></div><div><a href=x>two</a></div>{rest}")
    lines = [("".join(x.parts), x) for x in parser.lines if x.parts]
    assert [lines[i][0][:5] for i in chosen(parser, lines)] == ["A par"] * 3
    assert len(chosen(parser, lines, threshold=-1.0)) > 3


def test_the_threshold_decides_on_the_table():
    """Without a threshold, or with one that no line reaches, most pages come out differently, marked articles or not."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]

    def text(html, threshold):
        parser = lines_of(html)
        lines = [(" ".join("".join(x.parts).split()), x) for x in parser.lines]
        lines = [(t, x) for t, x in lines if t]
        return "\n".join(lines[i][0] for i in chosen(parser, lines, threshold))

    for change in (lambda h: h, lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")):
        for threshold in (-1e9, 1e9):
            assert sum(text(change(h), threshold) != main_text(h) for h in pages) > 0.8 * len(pages)
        assert all(main_text(change(h)) == main_text(h) for h in pages)


def test_hostile_pages():
    """Malformed declarations, and tags that would take a time that grows with the square."""
    assert main_text("<p>a<![foo[bar]]>b</p>") == main_text("<p>a<![CDATA[x>b") == main_text("<p>a<!ELEMENT x>b") == "ab"
    assert main_text("<p>5 < 6") == "5 < 6" and main_text("<p>a</p>b <i") == "a\nb"
    for page in ("<p>x</p>" + "<a x=" * 30_000, '<a x="' * 30_000, "<div>" * 20_000 + "</span></ul>" * 20_000, "<!--" * 30_000, "<![x" * 30_000, "<b " * 30_000 + ">", "<" * 100_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 3, page[:12]


def test_defined_cases(spark):
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == main_text("<p> \n </p>") == ""
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<p>a<p>b</div></p><li>c") == "a\nb\nc"
    assert main_text("<article><p>open <b>tags <i>only") == "open tags only"
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 1), (None, "v", "", 2), (3, "w", "<p>" + "word " * 300_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert found[1, "u"] == (TEXT, len(TEXT)) and found[2, None] == ("", 0) and found[None, "v"] == ("", 0) and found[3, "w"][1] == 5 * 300_000 - 1
    assert extract(df).count() == 5 and extract(df.limit(0)).count() == 0


def test_table(spark):
    """In the table's pages the article is marked, so its blocks can be cut out by hand."""
    import html

    for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b), r.page_id


def test_pieces():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0) and smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2
    assert 1 < two_means(np.array([0, 1, 1, 9, 10.0])) < 9 and two_means(np.array([4.0, 4.0])) <= 4
    p = Lines()
    p.feed("<p>one<p>two")
    p.close()
    assert ["".join(x.parts) for x in p.lines if x.parts] == ["one", "two"]
