"""Main text of pages of known layouts."""

import random
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from loomframe.llm import htmltext as H

BODY = "<h1>Title of it</h1><p>First  para with <b>bo</b>ld &amp; <a href='x'>a link</a> in\nit and more words.</p><p>Second para, which is long enough to count as text.<br>Line.</p>"
TEXT = "Title of it First para with bold & a link in it and more words. Second para, which is long enough to count as text. Line."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t u</title><style>p{a:b}</style></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><article>{}</article><footer>&copy; x y z words here</footer></body></html>",
        "<body><div class='menu'><a>one two</a></div><div class='content'>{}</div><div id='comments'><p>What a nice article this is, I like it a lot.</p></div></body>",
        "<body><header><a>Site name</a></header><main>{}<aside><p>Related: some other story of ours</p></aside></main></body>",
        "<div role='dialog'><p>We use cookies on this site to make it better for you.</p></div><div><div>{}</div></div><form><label>Your mail</label><input></form>",
        "<script>var a = '<p>x</p>';</script><!-- c --><article>{}<div class=\"ad\">Buy now our best things</div></article><aside class=sidebar><p>Popular words here</p></aside>",
        "<ARTICLE>{}</ARTICLE><noscript>enable it</noscript>",
    ],
)
def test_layouts(page):
    assert H.main_text(page.replace("{}", BODY), H.standard_weights()) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id=aspnetForm><div class=menu><a>one two</a></div><div class=content>{}</div></form></body>",
        "<body><nav><a>Home</a></nav><div class='content has-sidebar'>{}</div></body>",
        "<body><article class='post tag-share has-comments'>{}</article></body>",
        "<body><div class='elementor-element elementor-widget'><div class='elementor-widget-container'>{}</div></div></body>",
        "<body><div class='modal-open wrapper'>{}</div></body>",
        "<body><nav><ul><li><a>Home page</a></li></ul><article>{}</article></body>",
        "<body><aside><p>Other things</p><main>{}</main></body>",
        "<body><div class=widget>{}</div><div class=site-footer>words of it</div></body>",
    ],
)
def test_wrappers(page):
    assert H.main_text(page.replace("{}", BODY), H.standard_weights()) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<article>{}</article><div class=comments><article><p>What a nice article this is, I like it a lot and so do we all here, and more.</p></article></div>",
        "<div>{}</div><aside class=related><article><p>Some other story</p></article></aside>",
        "<article>{}</article><div class='comments-area'>" + "<p>many words of readers</p>" * 50 + "</div>",
    ],
)
def test_still_excluded(page):
    assert H.main_text(page.replace("{}", BODY), H.standard_weights()) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<body><nav><a>Home</a></nav><div class='layout has-sidebar'>{}</div></body>",
        "<body><div class='cookies-enabled'>{}</div></body>",
        "<div id=page class='hfeed site contact-page'><nav><a>x</a></nav><div>{}</div><footer>foo bar</footer></div>",
        "<article>{}</article><section><h3>3 comments</h3><p>What a nice article this is, I like it a lot and so do we all.</p><p>Another one says no to it all.</p></section>",
        "<article>{}</article><div class=kommentare><p>Was fuer ein Artikel, ich mag ihn sehr gern und wir alle auch.</p></div>",
        "<div>{}</div><div class='werbung'>Kaufen Sie jetzt</div>",
    ],
)
def test_quoted_pages(page):
    assert H.main_text(page.replace("{}", BODY), H.standard_weights()) == TEXT


def test_parts_of_the_article_stay():
    more = "<p class=notice>A notice that is of the article.</p><div class=post-tags-story><p>Story of tags.</p></div><p>An end.</p>"
    assert H.main_text(f"<article>{BODY}{more}</article>", H.standard_weights()) == TEXT + " A notice that is of the article. Story of tags. An end."
    links = "<div class=related>" + "<li><a href=x>Some other story here</a></li>" * 30 + "</div><p>A second half of the text, which goes on.</p>"
    for outer in ("div", "article"):
        assert H.main_text(f"<{outer}>{BODY}{links}</{outer}>", H.standard_weights()) == TEXT + " A second half of the text, which goes on."
    listed = f"<article>{BODY}<ul>" + "<li><a href=x>Some other story here</a></li>" * 30 + "</ul><p>A second half.</p></article>"
    got = H.main_text(listed, H.standard_weights())
    assert got.startswith(TEXT) and got.endswith("A second half.")
    assert H.main_text(f"<p title=it's>One two three.</p>{BODY}<p>Isn't it four?</p>", H.standard_weights()) == f"One two three. {TEXT} Isn't it four?"


WORDS = " ".join(f"word{i}" for i in range(30))
COMMENTS = "".join(f"<div class=entry2><b>Reader {i}</b><p>What a nice article this is, I like it a lot.</p></div>" for i in range(3))


@pytest.mark.parametrize(("opened", "closed"), [("<article>", "</article>"), ("<div>", "</div>"), ("<div class=content>", "</div>"), ("<div><section>", "</section></div>"), ("", "")])
@pytest.mark.parametrize(
    ("inner", "said"),
    [
        ("<table>" + "<tr><td>a</td><td>b</td></tr>" * 40 + "</table>", "a b " * 40),
        ("<div class=t><table><tbody>" + "<tr><th>a</th><td><span>b</span></td></tr>" * 40 + "</tbody></table></div>", "a b " * 40),
        ("<ul>" + "<li>item</li>" * 40 + "</ul>", "item " * 40),
        ("<ul>" + "<li><a href=x>link</a></li>" * 30 + "</ul>", "link " * 30),
        ("<dl>" + "<dt>t</dt><dd>d</dd>" * 40 + "</dl>", "t d " * 40),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds</p>", "so x=2 holds "),
    ],
)
def test_tables_lists_and_formulas_stay(opened, closed, inner, said):
    page = f"<body><nav><a>Home</a></nav>{opened}<h1>Title here</h1><p>{WORDS}</p>{inner}<p>{WORDS}</p>{closed}<footer>words of it</footer></body>"
    assert H.main_text(page, H.standard_weights()) == f"Title here {WORDS} {said}{WORDS}"


@pytest.mark.parametrize("inner", ["<table>" + "<tr><td>a</td><td>b</td></tr>" * 40 + "</table>", "<ul>" + "<li>a</li><li>b</li>" * 40 + "</ul>"])
def test_an_article_may_end_with_a_list(inner):
    for opened, closed in (("<article>", "</article>"), ("<div class=content>", "</div>")):
        page = f"<body><nav><a>Home</a></nav>{opened}<h1>Title here</h1><p>{WORDS}</p>{inner}{closed}<footer>words of it</footer></body>"
        assert H.main_text(page, H.standard_weights()) == f"Title here {WORDS} " + " ".join(["a b"] * 40)


@pytest.mark.parametrize("opened", ["<article>", "<main>", "<div class=content>", "<div class=x>"])
@pytest.mark.parametrize("mark", ["section id=discussion", "div class=kommentarii", "div class=randspalte", "div class=q7"])
def test_comments_and_side_columns_without_a_known_name(opened, mark):
    page = f"<body><nav><a>Home</a></nav>{opened}<h1>Title here</h1><p>{WORDS}</p><p>{WORDS}</p></{opened.strip('<>').split()[0]}><{mark}>{COMMENTS}</{mark.split()[0]}></body>"
    assert H.main_text(page, H.standard_weights()) == f"Title here {WORDS} {WORDS}"


def test_parts_of_one_kind_stay_together():
    page = "<body>" + "".join(f"<div class=part>{'<h1>Title here</h1>' if not i else ''}<p>{WORDS * n}</p></div>" for i, n in enumerate((5, 2, 1))) + "</body>"
    assert H.main_text(page, H.standard_weights()) == f"Title here {WORDS * 5} {WORDS * 2} {WORDS}"


def test_region_is_the_best_of_all_intervals():
    r = random.Random(5)
    for _ in range(300):
        gains = [r.choice([-1.5, -0.4, 0.0, 0.3, 2.0]) for _ in range(r.randint(0, 30))]
        every = [(sum(gains[i:j]), i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)]
        start, end = H.best_region(gains)
        assert abs(sum(gains[start:end]) - max([0.0, *(x for x, *_ in every)])) < 1e-9
    for html, *_ in H.labelled_pages(20, 3):
        gains, _ = H.scored(html, H.standard_weights())
        sums = [0.0]
        for g in gains:
            sums.append(sums[-1] + g)
        start, end = H.best_region(gains)
        assert abs(sums[end] - sums[start] - max(b - a for i, a in enumerate(sums) for b in sums[i:])) < 1e-6


def test_time_grows_with_the_page():
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        H.main_text("<div>" * n + "</p>" * n + "<aside><article>" * n + "x y z", H.standard_weights())
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


@pytest.mark.parametrize("outer", [("<article>", "</article>"), ("<div>", "</div>"), ("<div class=content>", "</div>")])
@pytest.mark.parametrize("inner", ["<div class=share>" + "<a href=x>Share</a> " * 5 + "</div>", "<aside><ul>" + "<li><a href=x>Other story</a></li>" * 10 + "</ul></aside>"])
def test_inner_link_lists(outer, inner):
    page = "<body><nav><a>Home</a></nav>" + outer[0] + BODY.replace("</h1>", "</h1>" + inner).replace("words.</p>", "words.</p>" + inner) + outer[1] + "<footer>words of it</footer></body>"
    assert H.main_text(page, H.standard_weights()) == TEXT


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        own = re.sub(r"<[^>]*>?", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", own))
        assert got[r["page_id"]] == " ".join(unescape(own).split())


def test_held_out_pages():
    good = 0
    own = H.labelled_pages(200, 99)
    for html, start, end in own:
        want = re.sub(r"<script.*?</script>|<aside>.*?</aside>|<div class=\"ad\">.*?</div>", " ", html[start:end], flags=re.S)
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", want)).split()).split()
        got = H.main_text(html, H.standard_weights()).split()
        good += len(set(got) & set(want)) >= 0.9 * len(set(got) | set(want))
    assert good >= 180


def test_edge_tables(spark):
    kind = "page_id long, url string, html string"
    assert H.extract(spark.createDataFrame([], kind)).count() == 0
    odd = ["", None, "no tags at all here", "<p>cut of<b", "<!-- open", "<script>open", "<nav>only menu</nav>", "<p>&lt;x&gt; &#233; &nbsp; y z w</p>", "<p>" + "long " * 50000, "< p > a b c", "<p>a</q></p>b c d"]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)], kind).withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(df).collect()}
    assert got[0] == got[1] == got[4] == got[5] == got[6] == ("", 0)
    assert got[2][0] == "no tags at all here" and got[7][0] == "<x> é y z w" and got[8][1] == 249999
    assert all(n == len(t) for t, n in got.values())
