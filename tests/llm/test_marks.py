"""Class names as marks of furniture, links within articles, and pages made to stall a scanner."""

from __future__ import annotations

import time

import pytest

from mapquarry.llm import html

BODY = "<h1>The title of the page</h1>" + "".join(
    f"<p>The story of the town and of the river is that it was there for all who came to it and for those who left it, number {i}.</p>" for i in range(5)
)
SHELL = "<html><body><nav><ul><li><a href=/x>Home</a></li></ul></nav>%s<footer>copyright of the site</footer></body></html>"
TEXT = html.main_text(SHELL % f"<article>{BODY}</article>")
NOTE = "<p>The best of the stories that I have read on this site and for me it is the one that I like.</p>"


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="container no-sidebar">%s</div>', '<div class="has-comments">%s</div>', '<div class="site with-sidebar">%s</div>', '<div class="page-header-fixed">%s</div>',
        '<div id="layout-2-sidebar">%s</div>', '<div class="content ad-free">%s</div>', '<article class="post tag-notices">%s</article>',
        '<div class="has-comments"><div class="no-sidebar"><article>%s</article></div></div>',
    ],
)
def test_a_wrapper_that_names_furniture_keeps_the_article(wrapper):
    assert TEXT.count("\n") == 5
    assert html.main_text(SHELL % (wrapper % BODY)) == TEXT
    aside = f'<div class="comment-list">{NOTE * 3}</div><div class="ad-slot">{NOTE}</div><div class="sidebar">{NOTE}</div>'
    assert html.main_text(SHELL % (wrapper % f"<div>{BODY}</div>{aside}")) == TEXT


def test_long_comments_stay_out_and_unknown_languages_in():
    assert html.main_text(SHELL % f'<div class="post">{BODY}</div><div class="comments-area">{NOTE * 20}</div>') == TEXT
    foreign = "<p>Mbona zuri kabisa vitu vingi sana hapa leo asubuhi mapema kwenye soko kubwa katikati mji mkubwa huu wetu sote pamoja.</p>"
    assert html.main_text(SHELL % f'<div class="no-sidebar">{foreign * 3}</div>').count("Mbona") == 3


def test_links_headings_and_quotes_inside_an_article():
    page = (
        "<article><p data=it's>The text of the story is here and it is that which it was for all of us in the town.</p>"
        "<p>See <a href=/r>all the reports of the year that we have published in the past years and this one</a></p>"
        "<h2>Sources</h2><ul><li><a href=/1>Annual report</a></li><li><a href=/2>Second report</a></li></ul></article>"
    )
    assert html.main_text(page).split("\n")[1:] == ["See all the reports of the year that we have published in the past years and this one", "Sources", "Annual report", "Second report"]
    assert html.main_text(page).startswith("The text of the story")


@pytest.mark.parametrize(
    "part",
    ["<a ", "<a x='", "<div>", "</p><div>", "b", "<p class='ad-x ", "&", "<", "</script ", "<script>", "<!--", "a=", "<a = ", "hidden display: ", '<div class="no-ad">', "<![CDATA[", '="', "<li><a href=x>"],
)
def test_pages_made_to_stall(part):
    for page in (part * (500_000 // len(part)) + "'", "<a " + part * (500_000 // len(part)) + ">"):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 4
