"""Pages that quadratic parsers stall on, and text in elements that have a fallback."""

import time

import pytest
from barloom.llm import html_crf


@pytest.mark.parametrize("page", ["<div>x" * 40_000, "<a " * 100_000, '<a "' * 100_000, "<li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000, "</x>" * 100_000, "<script>" * 50_000, "<!-- " * 50_000, "<head>" * 50_000, "<p>" * 100_000])
def test_long_and_open_pages_take_linear_time(page):
    began = time.process_time()
    html_crf.features(html_crf.blocks(page))
    assert time.process_time() - began < 20


def test_open_tags_and_quotes():
    texts = lambda page: [t for t, _, _ in html_crf.blocks(page)]
    assert texts('<p title="a > b">one</p><p>two <3 three') == ["one", "two <3 three"]
    assert texts("<p>one <math><mi>x</mi></math> two</p>") == ["one x two"] and texts("<p>a<noscript>b</noscript></p>") == ["ab"]
    assert texts('<p class="x>one') == ["one"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]


def test_places_add_up():
    (_, place, linked), = html_crf.blocks("<article><div class='post ad'><p><a href=x>all</a></p></div></article>")
    assert place.tags >= {"article", "div", "p"} and place.words == {"post", "ad"} and place.marked and place.off and linked == 1
