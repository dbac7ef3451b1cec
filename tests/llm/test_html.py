from __future__ import annotations

from forja.llm import op10_html_extract as op

LONG = "This paragraph has enough words to be the dense part of a page, as an article would."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_article_among_furniture():
    html = page(
        "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div>"
        f"<article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Of.</p><p>Two&nbsp;&lt;b&gt;\n words</p></article>"
        "<aside>Side</aside><div id='comments'><p>A reader writes a rather long comment on this page, indeed.</p></div>"
        "<div class='cookie-notice'>We use cookies</div><form><input><label>Mail</label></form><footer>&copy; me</footer>",
        "<style>p{margin:0}</style><script>var t=\"</p>\";</script>")
    assert op.main_text(html) == f"Head & line {LONG} Of. Two <b> words"


def test_without_article_element():
    html = page("<div class='menu'><a href='/a'>A</a> <a href='/b'>B</a></div><div id='content'>"
                + "".join(f"<p>{LONG} {i}</p>" for i in range(4)) + "<p>Short.</p></div><div class='links'><a href='/c'>See all of the other pages here</a></div>")
    assert op.main_text(html) == " ".join([*(f"{LONG} {i}" for i in range(4)), "Short."])


def test_odd_pages():
    assert op.main_text(None) == "" and op.main_text("") == "" and op.main_text("<nav>a</nav>") == "" and op.main_text("<p") == "<p"
    assert op.main_text("plain text") == "plain text"
    assert op.main_text("<article><p>open <i>and</b> crossed <!-- gone") == "open and crossed"
    assert op.main_text("<article><script>x</article>") == ""
    assert len(op.main_text("<article>" + "<div>" * 3000 + "deep" + "<p>more</p>" * 3000 + "</article>")) == 4 + 3000 * 5
    assert op.main_text(page(f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article>")) == LONG


def test_wrappers_of_the_article_are_no_furniture():
    article, nav = f"<article><p>{LONG}</p></article>", "<nav><a href='/'>Home</a></nav>"
    for name in ("has-sidebar", "layout with-sidebar", "no-comments", "content-with-nav", "site-header", "page-overlay"):
        assert op.main_text(page(f"<div class='{name}'>{nav}{article}<div class='sidebar'>Side</div></div>")) == LONG
    assert op.main_text(page(f"<form id='aspnetForm'>{nav}<div><main><p>{LONG}</p></main></div><fieldset>Mail</fieldset></form>")) == LONG
    assert op.main_text(page(f"<form>{nav}<div><p>{LONG}</p><p>{LONG}</p></div></form>")) == f"{LONG} {LONG}"
    assert op.main_text(page(f"<div class='widget'><div class='promo'>{article}</div></div>")) == LONG
    assert op.main_text(page(f"{article}<div class='related'><article><p>{LONG} {LONG}</p></article></div>")) == LONG
    assert op.main_text(page(f"<div><p>{LONG}</p></div><div id='comments'><article class='comment'><p>{LONG} {LONG}</p></article></div>")) == LONG


def test_headings_inside_the_article():
    for head in ("<header><h1>Head</h1></header>", "<div class='entry-header'><h1>Head</h1></div>", "<h1 class='entry-header banner'>Head</h1>"):
        assert op.main_text(page(f"<header>Site</header><article>{head}<p>{LONG}</p></article>")) == f"Head {LONG}"


def test_sections_of_the_article_with_ordinary_names():
    for part in ("section id='related-work'", "section class='search-methods'", "div class='social-history x'", "div id='legal_background'"):
        assert op.main_text(page(f"<article><p>{LONG}</p><{part}><p>{LONG} Too.</p></{part.split()[0]}></article>")) == f"{LONG} {LONG} Too."
    links = "".join(f"<li><a href='/{i}'>{LONG}</a></li>" for i in range(4))
    for name in ("related-posts", "related", "social-share", "cookie-notice", "site-notice", "search-box", "reader-comments", "notice-2"):
        assert op.main_text(page(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} Too.</p></div></article>")) == LONG
    assert op.main_text(page(f"<article><p>{LONG}</p><div class='related-topics'><ul>{links}</ul></div></article>")) == LONG
    assert op.main_text(page(f"<article><p>{LONG}</p><div class='search-tips'>Try again</div></article>")) == LONG


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (1, "u", f"<article><p>{LONG}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(op.extract(df).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(None, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG))]
    assert op.extract(df.limit(0)).count() == 0
