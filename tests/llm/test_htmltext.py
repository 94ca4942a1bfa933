"""Main text of pages of several shapes."""

import numpy as np
import pytest

from tablefill.llm import htmltext

P = "<p>A paragraph of running text that is long enough to be content, with several words in it.</p>"
T = "A paragraph of running text that is long enough to be content, with several words in it."

CASES = [
    ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a", "a"),
    (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1>{P}<p>Sh.</p></article><footer>c</footer>", f"Title\n\n{T}\n\nSh."),
    (f"<body><header>Site</header><main>{P}<aside>no</aside>{P}</main><div class='comments'><p>reader</p></div></body>", f"{T}\n\n{T}"),
    (f"<article>{P}<div class=\"ad\">buy</div><form>name</form><script>if (a < b) {{}}</script><style>p{{}}</style>{P}</article>", f"{T}\n\n{T}"),
    ("<article><p>a &amp; b &lt;c&gt; &#233; &nbsp; d</p></article>", "a & b <c> é d"),
    ("<article><p><b>one<br>two</p><p>three<br></article>", "one two\n\nthree"),
    (f"<div id=content>{P}<p>x</p></div><div class=sidebar><ul><li>links</li></ul></div>", f"{T}\n\nx"),
    ("<!-- c --><article><!-- ad --><p>kept</p>", "kept"),
    ("<![if IE]><p>a<![endif]><p>b<![ x", "a\n\nb"), ("<p>a<!-- open", "a"), ("<p>one<p a='x>two</p>", "one\n\ntwo"),
    (f"<nav><ul><li>Home<article>{P}</article>", T), ("a < b &amp; c", "a < b & c"),
    (f"<article>{P}<section class='user-comments'><p>me too, I have the same opinion on that</p></section></article>", T),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/c>Contact</a></li></ul></div>"
FOOT = "<div>All rights reserved</div>"


@pytest.mark.parametrize(("html", "text"), [
    (f'<div class="layout has-sidebar"><article>{P}</article><div class="sidebar">x</div></div>', T),
    (f'<div id="content-side"><main>{P}{P}</main></div>', f"{T}\n\n{T}"),
    (f'<div class="post no-comments">{P}{P}</div>', f"{T}\n\n{T}"),
    (f"<form><div><article>{P}</article></div></form>", T), (f"<form>{P}{P}</form>", f"{T}\n\n{T}"),
    (f"<div class=related><article>{P}</article></div><article><h2>Real</h2>{P}{P}</article>", f"Real\n\n{T}\n\n{T}"),
    (f"{MENU}<div><h1>Title</h1>{P}{P}<p>Short.</p>{P}</div>{FOOT}", f"Title\n\n{T}\n\n{T}\n\nShort.\n\n{T}"),
    (f"<body>{MENU}<div class=wrap><div>{P}{P}</div><div>{P}{P}</div></div>{FOOT}</body>", "\n\n".join([T] * 4)),
    (f"<table><tr><td>Home<br>About</td><td>{P}{P}{P}</td></tr></table>", "\n\n".join([T] * 3)),
])
def test_marks_never_empty_a_page_and_density_selects(html, text):
    assert htmltext.main_text(html) == text


def plain_smoothing(x, sigma):
    out = []
    for i in range(len(x)):
        w = [np.exp(-0.5 * ((i - j) / sigma) ** 2) if abs(i - j) <= int(3 * sigma) else 0 for j in range(len(x))]
        out.append(sum(a * b for a, b in zip(w, x)) / sum(w))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_smoothing_equals_the_plain_sum(seed):
    x = np.random.default_rng(seed).exponential(10, 1 + 7 * seed)
    assert np.allclose(htmltext.smoothed(x), plain_smoothing(x, htmltext.SIGMA))


def test_article_within_a_section():
    page = f"<div><ul><li><a href=/>Home</a></li></ul></div><section><div><article>{P}<section>{P}</section></article></div></section>"
    assert htmltext.main_text(page) == f"{T}\n\n{T}"


def test_smoothing_keeps_constants():
    assert np.allclose(htmltext.smoothed(np.full(9, 4.0)), 4.0)
    assert np.allclose(htmltext.smoothed(np.array([7.0])), 7.0)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "y"), (2, "v", CASES[4][0], "z"), (2, "v", CASES[4][0], "z")],
                                  "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in htmltext.page_texts(pages).collect())
    text = CASES[4][1]
    assert got == [("1", "", 0), ("2", text, len(text)), ("2", text, len(text)), ("None", "", 0)]
    assert htmltext.page_texts(pages.limit(0)).count() == 0


def test_deep_and_long_pages():
    assert htmltext.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(htmltext.main_text("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 11 - 2


def test_any_markup_is_taken():
    import random
    rng = random.Random(1)
    parts = ["<", "p", ">", "/", "!", "[", "]", "--", "&", "#x", "a", "'", '"', "=", "<p>", "</p>", "<![", "?", "<script>", "</script>",
             "<!--", "-->", " ", "CDATA[", "<article>", "</article>", "<div class='ad'>", "\n"]
    for _ in range(4000):
        assert isinstance(htmltext.main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))), str)
