import pytest

from regionpanel.llm import html_text as M

LONG = "A long enough paragraph of the story with many words in it and more to come."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""),
    (f"<body><nav><a href=/>Home</a></nav><article><h1>T &amp; &#85;</h1><p>Be.<p>{LONG}</article><footer>F</footer>", f"T & U\nBe.\n{LONG}"),
    (f"<article><p>a<b>b</b>c<br>d\n  e&nbsp;f</p><script>var x='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}", f"abc d e f\n{LONG}"),
    (f"<div id=main-content><p>{LONG}</p><div class='ad-box'>Buy</div><p>Be.</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", f"{LONG}\nBe.\n{LONG}"),
    (f"<div class='cookie-notice'>We use cookies</div><aside>{LONG}</aside><main><p>Tiny.</p></main><form><input><label>Name</label></form>", "Tiny."),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><section id=comments><p>I disagree</p></section></article>", f"Title\n{LONG}"),
    (f"<article><p>{LONG}</p><p>cut he", f"{LONG}\ncut he"),
    ("<article><p>1 &lt; 2 &eacute;&#x1F600;</p></article>", "1 < 2 é\U0001f600"),
    ("<p>plain < text & more</p><p>next</p>", "plain < text & more\nnext"),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><p hidden>no</p><p>{LONG}</p></article>", f"one\ntwo\nx\ny\n{LONG}"),
    ('<article><p title="a > b">quoted</p></article>', "quoted"),
])
def test_pages(page, text):
    assert M.main_text(page) == text


def test_link_lists_have_no_surge():
    menu = "".join(f"<div><a href=/{i}>Some link text {i}</a></div>" for i in range(30))
    assert M.main_text(f"<body>{menu}<div><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div>{menu}</body>") == f"{LONG}\nBe.\n{LONG}"


def test_query_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 9), (1, "u", f"<article><p>{LONG}</p></article>", 9), (2, None, None, 9), (None, "v", "<p>x", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = [tuple(r) for r in M.extract(df).collect()]
    assert sorted(out, key=repr) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (None, "v", "x", 1)], key=repr)
    assert M.extract(df.limit(0)).collect() == []


def test_long_page_is_linear():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "<a title='" + "<p>" * 1000
    assert M.main_text(page).count(LONG) == 20_000


def test_a_teaser_mark_does_not_hide_a_plain_body():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20))
    for teaser in (f"<article><p>{LONG}</p></article>", "<article class=related><p>More here of this and that</p></article>"):
        text = M.main_text(f"<body><div>{body}</div>{teaser}</body>")
        assert all(f"{LONG} {i}" in text.split("\n") for i in range(20))


def test_a_mark_is_a_weight_and_a_boundary():
    article = f"<article><p><a href='/a'>First</a></p><p>{LONG * 3}</p><p><a href='/a'>Last</a></p></article>"
    assert M.main_text(f"<div>Some tag line</div>{article}<div>Printed on paper</div>") == f"First\n{LONG * 3}\nLast"
    assert M.main_text(f"{article}<div><p>{LONG}</p><p>{LONG}</p></div>") == f"First\n{LONG * 3}\nLast\n{LONG}\n{LONG}"


def test_one_long_paragraph_hides_nothing():
    page = "<h2>Title</h2>" + f"<p>{'x' * 20}</p>" * 3 + f"<p>{'y' * 5000}</p>"
    assert M.main_text(page) == "\n".join(["Title"] + ["x" * 20] * 3 + ["y" * 5000])
    links = "<div><a href='/a'>A link</a></div>" * 3
    assert M.main_text(f"<p>{'x' * 35}</p>{links}<p>{'y' * 5000}</p>") == "x" * 35 + "\n" + "y" * 5000


def test_short_lines_before_the_surge_and_link_lines_inside_stay():
    page = f"<div>On</div><div><a href='/a'>All</a></div><div>By</div><p>{LONG}</p><p><a href='/a'>A whole line</a></p><p>{LONG}</p><p>{LONG}</p>"
    assert M.main_text(page) == f"On\nAll\nBy\n{LONG}\nA whole line\n{LONG}\n{LONG}"


def test_links_are_counted_decoded():
    assert M.lines("<p>See <a>A &amp; B &mdash;   C</a></p>") == [("See A & B \u2014 C", 3, False)]
    assert M.main_text("<p>See <a>A &amp; B &mdash; C</a></p>") == "See A & B \u2014 C"


@pytest.mark.parametrize("page", [
    f"<div id=page class=no-sidebar><article><p>{LONG}</p><p>Be.</p></article></div>",
    f"<div class='content-with-sidebar'><p>{LONG}</p><p>Be.</p></div><div class=sidebar><p>Some other things</p></div>",
    f"<body><div class='has-share-buttons'><p>{LONG}</p><p>Be.</p></div>",
    f"<div class='post-header-and-content'><article><p>{LONG}</p><p>Be.</p></article><div class=comments><p>{LONG} {LONG}</p></div></div>",
    f"<div class='site-menu'><main><p>{LONG}</p><p>Be.</p></main></div><article class='related'><p>{LONG}</p></article>",
    f"<article><p>{LONG}</p><p>Be.</p></article><div class=ad><p>{LONG * 9}</p></div>",
])
def test_class_words_of_wrappers(page):
    assert M.main_text(page) == f"{LONG}\nBe."


@pytest.mark.parametrize("part, kept", [
    ("<section id='discussion'><p>Results follow here.</p></section>", "Results follow here."),
    ("<h2 id='data-sharing-policy'>Data sharing</h2>", "Data sharing"), ("<h2 id=comments>On comments</h2>", "On comments"),
    ("<p class='legal-analysis'>An opinion.</p>", "An opinion."), ("<li id=related>One point</li>", "One point"),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>", "where x=2 holds"),
    ("<section id=comments><p>First!</p></section>", None), ("<p class=advert>Buy</p>", None), ("<ol class=commentlist><li>First!</li></ol>", None),
    ("<p class='cookie-notice'>We use them</p>", None), ("<div id=disqus>Talk</div>", None),
])
def test_words_that_title_or_name(part, kept):
    assert M.main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == "\n".join([LONG, *([kept] if kept else []), LONG])


def test_a_list_of_reader_comments_outside_the_article_goes():
    assert M.main_text(f"<div><p>{LONG * 4}</p><p>{LONG * 4}</p></div><ol class='commentlist'><li>{LONG}</li><li>{LONG}</li></ol>") == f"{LONG * 4}\n{LONG * 4}"


@pytest.mark.parametrize("unit", ["<a x=\"", "<a x='>\"", "<a x=\">\"", "<a x=\">\" y='", "</x>", "<div", "<!", "<a \"'"])
def test_hostile_markup_takes_linear_time(unit):
    import time

    def seconds(n):
        page = f"<article><p>{LONG}</p>" + "<div>" * 2000 + unit * n + "'"
        t = time.perf_counter()
        M.main_text(page)
        return time.perf_counter() - t

    seconds(100)
    assert seconds(40_000) < 20 * seconds(10_000) / 2 + 0.5 and seconds(40_000) < 5
