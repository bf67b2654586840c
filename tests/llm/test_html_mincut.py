"""Main text of pages, the cut against brute force, odd markup."""

import itertools
import random
import time

import pytest

from summarium.llm import html_mincut as H

PAGE = """<!DOCTYPE html><html><head><title>Head title</title><style>p{color:red}</style>
<script>var x = "</p><p>not text";</script></head><body class="no-sidebar">
<header><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work better for all of you.</div>
<form action="/s"><input name="q"><button>Search</button></form>
<div id="main-content"><article><header><h1>A   title &amp; more</h1></header>
<p>First paragraph, with <b>bold</b> and <a href="#">a link</a>&nbsp;inside it.</p><!-- hidden <p>x</p> -->
<p>Yes.<p>Second&#32;paragraph &lt;code&gt; with a
line break<br>and more words that go on for a while.
<div class="ad">Buy this great thing now, only today, it is cheap.</div>
<ul><li>Point one of the list is here.</li><li>Point two of the list.</li></ul>
<p>Last paragraph of the article, which ends here.</p></article>
<section class="comments"><h2>Comments</h2><p>I think this article is very good, says a reader at length.</p></section></div>
<aside class="sidebar"><h3>Related</h3><p>Another story that you may like to read today, dear reader.</p></aside>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
WANT = ("A title & more First paragraph, with bold and a link inside it. Yes. Second paragraph <code> with a "
        "line break and more words that go on for a while. Point one of the list is here. Point two of the list. "
        "Last paragraph of the article, which ends here.")


def test_page():
    assert H.main_text(PAGE) == WANT


def test_page_without_semantic_tags():
    page = ("<body><div class='menu'><a href=1>One</a> <a href=2>Two</a></div><div>"
            + "".join(f"<p>Paragraph {i} has a good number of words in it, and ends with a stop.</p>" for i in range(4))
            + "<p>Ok.</p></div><div class='footer'>Contact us by mail</div></body>")
    assert H.main_text(page) == " ".join(
        f"Paragraph {i} has a good number of words in it, and ends with a stop." for i in range(4)) + " Ok."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>",
                                  "a < b > c", "<p title=\"open quote>text", "<" * 3000, "<p>" * 3000,
                                  "<div>" * 3000 + "deep text", "&", "&#0;&#xD800;&bogus;"])
def test_odd_markup_ends(page):
    assert isinstance(H.main_text(page), str)


def test_long_page_is_linear():
    page = "<article>" + "<p>Some words of a paragraph, and a stop.</p>" * 8000 + "</article>"
    assert H.main_text(page).count("paragraph") == 8000


ARTICLE = ("<article{}><h1>A title here</h1><p>A paragraph of the article that has enough words in it, and a stop.</p>"
           "<p>Yes.</p></article>")
ARTICLE_TEXT = "A title here A paragraph of the article that has enough words in it, and a stop. Yes."


@pytest.mark.parametrize("own", ["", ' class="post has-sidebar category-reviews"', ' class="ad-free"'])
@pytest.mark.parametrize("page", [
    '<div class="has-sidebar">{}</div>', '<div class="sidebar-layout">{}</div>', "<form>{}</form>",
    '<div class="content-sidebar-wrap">{}<aside>Text at the side, of some length, stands here.</aside></div>',
    '<main class="ad-free">{}</main>', '<main class="site-main no-banner">{}</main>',
    '<div class="post comments-open">{}</div>', '<div data-role="banner" data-id="ad">{}</div>',
    '<div class="main-header"><p>The header of the site, so long that it looks like a text.</p></div>{}',
    '{}<section class="related"><article><h3>Teaser</h3><p>Another story, which has some words.</p></article></section>',
    '{}<div id="comments"><p>A reader says that this is very good, and goes on and on at length.</p></div>'])
def test_class_words_delete_no_article(page, own):
    assert H.main_text(page.format(ARTICLE.format(own))) == ARTICLE_TEXT


def test_short_page_without_marks():
    assert H.main_text("<h1>Title</h1><p>Yes.</p>") == "Title Yes."
    assert H.main_text("<nav><a href=x>Yes</a></nav>") == ""


def test_short_and_long_lines_of_a_zone_stay_together():
    items = "".join(f"<li>Item {i}</li>" for i in range(40))
    assert H.main_text(f"<article><p>Short.</p><ul>{items}</ul></article>").startswith("Short. Item 0 Item 1 ")
    long = "<p>A paragraph of a footer that is as long as one of an article, and ends with a stop.</p>" * 9
    assert H.main_text(f"<article><p>Short.</p></article><footer>{long}</footer>") == "Short."


def generated(rnd):
    """A page without semantic tags and class names, with the truth of every block."""
    words = "river stone market paper window garden letter morning engine harbour".split()

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."

    def menu(n):
        return "".join(f'<li><a href="/{i}">{text(rnd.randint(1, 2))}</a></li>' for i in range(n))

    body, truth = [f"<div><ul>{menu(5)}</ul></div><div>"], [False] * 5
    for _ in range(rnd.randint(5, 12)):
        body.append(f"<p>{text(rnd.choice([1, 1, 12, 25, 40]))}</p>")
        truth.append(True)
    body.append("</div><div><ul>" + menu(3) + f"<li>{text(6)}</li>" + menu(3) + "</ul></div>")
    return "".join(body), truth + [False] * 7


def test_the_cut_changes_labels_for_the_better():
    rnd = random.Random(5)
    changed = by_sign = by_cut = total = 0
    for _ in range(200):
        page, truth = generated(rnd)
        sign = [H.evidence(b) > 0 for b in H.parsed(page)[0]]
        cut = [s for _, s in H.labelled(page)]
        assert len(cut) == len(truth)
        total += len(truth)
        changed += sum(a != b for a, b in zip(sign, cut))
        by_sign += sum(a == b for a, b in zip(sign, truth))
        by_cut += sum(a == b for a, b in zip(cut, truth))
    assert changed > 0.05 * total
    assert by_cut > by_sign + 0.05 * total and by_cut > 0.95 * total


N = 20_000


@pytest.mark.parametrize("page", [
    "<b>" * N + "</i>" * N + "<p>x", "<div>" * N + "</div>" * N, "<div>t" * N, "<blockquote>a" * N,
    "<table>" + "<tr><td>a" * N + "<li>b" * N, "<b>x<br>" * N, "<b>" * N + "<p>x" * N, "<ul>" + "<li><dt>a" * N,
    "<" + "a" * 10 * N, '<a "' * N, "<a '>" * N, "<!--" * N, '<div class="' + "a " * 10 * N + '">x',
    "<div " + "class " * N + ">x", "<div class=ad>x" * N, "<p>abc</p>" * N + "<p>A paragraph long enough.</p>" * N,
    "<div class=content>" + "<p><a>abc</a></p><p>A longer text stands here, and it ends.</p>" * N + "</div>"])
def test_odd_markup_is_linear(page):
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 10


def cost(labels, t, edges):
    return (sum(-x if not s and x > 0 else 0 for s, x in zip(labels, t)) * -1
            + sum(-x for s, x in zip(labels, t) if s and x < 0)
            + sum(w for i, j, w in edges if labels[i] != labels[j]))


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_minimal(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 9)
    t = [round(rnd.uniform(-3, 3), 2) for _ in range(n)]
    edges = [(i, j, round(rnd.uniform(0, 2), 2)) for i in range(n) for j in range(i) if rnd.random() < 0.4]
    least = min(cost(s, t, edges) for s in itertools.product([False, True], repeat=n))
    assert cost(H.minimum_cut(t, edges), t, edges) == pytest.approx(least)


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x")],
                               "page_id long, url string, html string, text string")
    rows = sorted([tuple(r) for r in H.extract_pages(df).collect()], key=repr)
    assert rows == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert H.extract_pages(df.limit(0)).count() == 0
