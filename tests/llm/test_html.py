"""HTML extraction: nested boilerplate, pages whose names tell nothing, markup that never ends, odd rows."""

import time

import pytest
from pyspark.sql import functions as F

from vodlens.llm import html_extract, html_pages

TWO = "<p>First paragraph of the text, long enough.</p><p>Second paragraph of it.</p>"
SAID = "First paragraph of the text, long enough.\n\nSecond paragraph of it."


@pytest.mark.parametrize(
    "inner",
    [
        '<section class="comments"><p>Reader one says..</p></section>',
        '<div class=comment-list><div class=comment><b>Ann</b><p>I do not agree with any of this.</p></div></div>',
        "<div class=ad>Buy now!</div>",
        "<nav><a href=1>prev</a> <a href=2>next</a></nav>",
        "<form><input name=q><button>Go</button></form>",
        "<aside><p>Related: something else.</p></aside>",
        '<div class="cookie-notice"><p>We use cookies on this site.</p></div>',
        "<footer><p>&copy; 2020 The paper</p></footer>",
    ],
)
def test_boilerplate_inside_the_article_goes(inner):
    m = html_extract.default_model()
    assert m.extract(f"<body><article>{TWO}{inner}</article></body>") == SAID
    assert m.extract(f"<body><nav><a href=/>Home</a></nav><article>{TWO}{inner}</article><footer>&copy; me</footer></body>") == SAID


def test_names_that_tell_nothing():
    page = "<body><div class=xq1><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About</a></li></ul></div><div class=xq2><p>The council met on Monday to talk about the bridge, which has been closed.</p><p>Work will go on until spring, said the mayor.</p><ul><li>First point of the plan.</li><li>Second point of the plan.</li></ul></div><div class=xq3>We use cookies on this site. <button>OK</button></div></body>"
    assert html_extract.default_model().extract(page) == "The council met on Monday to talk about the bridge, which has been closed.\n\nWork will go on until spring, said the mayor.\n\nFirst point of the plan.\n\nSecond point of the plan."


def test_short_articles():
    m = html_extract.default_model()
    assert m.extract("<html><body><article><p>Only few words.</p></article></body></html>") == "Only few words."
    assert m.extract("<html><body><nav><a href=/>x</a></nav><article><p>Few words here</p></article><footer>&copy; me</footer></body></html>") == "Few words here"


@pytest.mark.parametrize("invented,least", [(0.0, 0.99), (1.0, 0.9)])
def test_held_out_pages(invented, least):
    """With all names made up, no name of these pages is one of the training pages'."""
    m, maker = html_extract.default_model(), html_pages.Maker(20_001, invented)
    right = total = 0
    for _ in range(120):
        tree = html_extract.parse(maker.page(), labels=True)
        for label, text, p in zip(tree.label, tree.text, m.marginals(tree)):
            if text is not None:
                total += 1
                right += (label == "c") == (p[0] == max(p))
    assert right / total > least


ENDLESS = {
    "open quotes": '<a "' * 100_000, "tags in tags": "<p>" + "<b <" * 100_000, "deep": "<div>" * 100_000 + "<p>text</p>", "lists": "<li><div>" * 20_000, "terms": "<div>" * 30_000 + "<dt>" * 30_000,
    "ends of nothing": "<div>" * 30_000 + "</p>" * 60_000, "comments": "<!-- " * 300_000, "pictures": "<svg>" * 200_000, "attribute quotes": "<a href='" * 100_000, "equals": "<a " + "= " * 400_000,
    "names": "<div " + "class=" * 200_000 + ">", "scripts": "<script>" * 200_000, "ends": "</" * 500_000,
}


@pytest.mark.parametrize("name", ENDLESS)
def test_time_is_linear(name):
    m, page = html_extract.default_model(), ENDLESS[name]
    began = time.process_time()
    assert isinstance(m.extract(page), str)
    assert time.process_time() - began < 8


def test_the_scanner_reads_what_is_there():
    texts = lambda page: [t for t in html_extract.parse(page).text if t]
    assert texts('<p title="a > b">one</p><p title=\'<p>\'>two</p><!----><!-- x --!>three<?php echo ?>four</ x>five < six') == ["one", "two", "threefourfive < six"]
    assert texts('<p class="open>one</p><p>two') == ["one", "two"] and texts("<svg><p>text") == ["text"] and texts("<script>text") == []
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", f"<article>{TWO}</article>"), (None, "v", f"<article>{TWO}</article>"), (3, "w", f"<article>{TWO * 3000}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(0, "v", SAID, len(SAID))] * 2 + [(1, "u", "", 0), (2, "", "", 0), (3, "w", "\n\n".join([SAID] * 3000), 3000 * (len(SAID) + 2) - 2)]
    assert html_extract.extract(pages.limit(0)).collect() == []


PARAS = ["The council met on Monday evening to talk about the old bridge, which has been closed since the spring floods.", "Work on the two piers will go on until autumn, said the mayor, and traffic has to take the northern road.", "Shops along the river have lost a third of their customers, according to a survey by the chamber of commerce."]
REMARK = "I think that this is great and we all should go there again next year with our friends because it was really good fun for every one of us and nobody was bored at any time of the day".split()


def remarks(tag, name, many, size, shape):
    said = [" ".join(REMARK[(7 * k + j) % len(REMARK)] for j in range(size)).capitalize() + "." for k in range(many)]
    item = (lambda c: f"<p>{c}</p>", lambda c: f"<div><b>Ann</b><p>{c}</p></div>", lambda c: f"<p><b>Ann</b>: {c}</p>")[shape]
    return f'<{tag} class="{name}">' + "".join(f"<li>{item(c)}</li>" if tag == "ol" else item(c) for c in said) + f"</{tag}>"


@pytest.mark.parametrize("name", ["comments", "comment-list", "reader-comments"])
@pytest.mark.parametrize("tag", ["section", "div", "ol", "aside", "article"])
def test_named_comments_in_the_article_go(tag, name):
    m, body = html_extract.default_model(), "".join(f"<p>{p}</p>" for p in PARAS)
    for many in (1, 2, 3, 5):
        for size in (1, 3, 8, 15, 25, 40):
            for shape in range(3):
                inner = remarks(tag, name, many, size, shape)
                assert m.extract(f"<body><article>{body}{inner}</article></body>") == "\n\n".join(PARAS), (many, size, shape)
                assert m.extract(f"<html><body><nav><a href=/>Home</a></nav><article>{body}{inner}</article><footer>&copy; 2020</footer></body></html>") == "\n\n".join(PARAS), (many, size, shape)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body>An ordinary sentence, which is the whole article of this page.</body>", "An ordinary sentence, which is the whole article of this page."),
        ("<body><nav><a href=/>Home</a> <a href=/n>News</a></nav>An ordinary sentence, which is the whole article of this page.</body>", "An ordinary sentence, which is the whole article of this page."),
        ("<body>First block of words that tell a story.<br><br>Second block of words, which goes on with it.</body>", "First block of words that tell a story. Second block of words, which goes on with it."),
        ("<body>" + "".join(f"<p>{p}</p>" for p in PARAS) + "</body>", "\n\n".join(PARAS)),
        ("<body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><h1>Bridge</h1>" + "".join(f"<p>{p}</p>" for p in PARAS) + "<p>&copy; 2020 The paper</p></body>", "\n\n".join(["Bridge", *PARAS])),
        ("<body><table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td>" + "".join(f"<p>{p}</p>" for p in PARAS) + "</td></tr><tr><td>Copyright 2020</td></tr></table></body>", "\n\n".join(PARAS)),
        (f"<body><article><h1>Bridge</h1><p>{PARAS[0]}</p><section><h2>Traffic</h2><p>{PARAS[1]}</p><p>{PARAS[2]}</p></section></article></body>", "\n\n".join(["Bridge", PARAS[0], "Traffic", *PARAS[1:]])),
        (f"<body><div class=content><p>{PARAS[0]}</p><div><p>{PARAS[1]}</p><p>{PARAS[2]}</p></div></div></body>", "\n\n".join(PARAS)),
    ],
)
def test_articles_without_an_article_element(page, want):
    assert html_extract.default_model().extract(page) == want
