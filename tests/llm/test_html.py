"""The page reader's time, its judging of inline and unknown elements, the decoding, and the quality on layouts not trained on."""

import itertools
import time
from collections import Counter

import numpy as np
import pytest

from darkslide.llm import html


@pytest.fixture(scope="module")
def extractor():
    return html.fit_extractor()


@pytest.mark.parametrize("fragment", ["<a ", '<a href="', "<a href='", "<a '\"", "<a<a", '<a "x" ', "<p><table><td>", "<div>", "<b>", "</b>", "<b><div></b>", "<!", "<!--", "<svg>", "<script>", "<head>", "<p>", "<li>", "<x-y>", "&am", "<span class=ad>", "<"])
def test_reading_takes_time_in_proportion(fragment):
    took = []
    for size in (100_000, 800_000):
        start = time.thread_time()
        html.parse(fragment * (size // len(fragment)))
        took.append(time.thread_time() - start)
    assert took[1] < 20 * max(took[0], 0.05)  # eight times the text; a reader that goes back takes 64 times as long


def test_inline_and_unknown_elements_are_judged(extractor):
    said = "A sentence of the article, long enough to be one and then some."
    page = f"""<html><body><my-header class=masthead><a href=/>The site</a></my-header><site-nav><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></site-nav>
    <article><h1>Title</h1><p>{said} <span class='ad'>Buy this now!</span> It goes on.</p><p>{said} <b>Bold <i>and slanted</i></b>, <a href=x>linked</a>, <x-icon></x-icon><span class="c7">plain</span>.</p><p>{said}</p></article>
    <my-sidebar class='sidebar'><h3>More</h3><p><a href=d>Four</a></p><p><a href=e>Five</a></p></my-sidebar><footer>(c) The site</footer></body></html>"""
    assert extractor.texts([page])[0].split("\n\n") == ["Title", f"{said} It goes on.", f"{said} Bold and slanted, linked, plain.", said]


def test_reader():
    of = lambda t: html.parse(t).texts()
    assert of("<p>a <b>b<div>c</b>d</div>e") == ["a b", "cd", "e"] and of("<a href='x>y' title=\"<b>\">z</a>") == ["z"]
    assert of("<p class=x <b>bold</b> rest") == ["bold rest"] and of("1 < 2 <3") == ["1 < 2 <3"] and of("x<a href=\"y>z") == ["xz"]
    assert of("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"] and of("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert of("<p>a<x-y>b</x-y>c</p><x-y>d</x-y>e") == ["abc", "d", "e"] and of("a<br>b<hr>c") == ["a b", "c"] and of("<script>x</script >y<style>z") == ["y"]


def test_decoding_is_the_likeliest_labelling():
    """Against all labellings in which a node above an all or none is nothing else."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        page = html.Page()
        page.add("html", -1, 0, None)
        for i in range(1, int(rng.integers(2, 6))):
            page.add("div", int(rng.integers(0, i)), 0, None)
        page.segments = [[(i, "x")] for i in range(len(page.tag)) if rng.random() < 0.6]
        if not page.segments:
            continue
        n, p = len(page.tag), np.clip(rng.random(len(page.tag)), 0.01, 0.99)
        speaks = html._speaking(page)
        filled = set(speaks)
        for i in range(n - 1, 0, -1):
            if i in filled:
                filled.add(page.parent[i])
        best = (-np.inf, None)
        for states in itertools.product((1, -1, 0), repeat=len(filled)):
            state = dict(zip(sorted(filled), states))
            if any(i and state[page.parent[i]] and state[page.parent[i]] != state[i] for i in state):
                continue
            score, out = 0.0, set()
            for i, s in state.items():
                score += np.log(p[i]) if s > 0 else np.log(1 - p[i]) if s < 0 else -html.MIXED + (max(np.log(p[i]), np.log(1 - p[i])) if i in speaks else 0)
                if i in speaks and (s > 0 or (s == 0 and p[i] > 0.5)):
                    out.add(i)
            best = max(best, (score, out), key=lambda x: x[0])
        got = html.decoded(page, p)
        assert {i for i in speaks if got[i]} == best[1]


def f1(extractor, pages):
    """Of the words of main text, over pages whose elements are marked."""
    parsed = [html.parse(p) for p in pages]
    right = found = there = 0
    for page, text in zip(parsed, extractor.texts(pages)):
        main = Counter(w for pieces in page.segments for w in html._joined([(i, t) for i, t in pieces if page.mark[i] == "1"]).split())
        got = Counter(text.split())
        right += (main & got).total()
        found += got.total()
        there += main.total()
    return 2 * right / (found + there)


def test_layouts_that_were_not_trained_on(extractor):
    maker = html._Maker(12345)
    assert f1(extractor, [maker.page() for _ in range(200)]) > 0.9


def test_attributes_of_marks_are_not_seen_by_the_trees(extractor):
    maker = html._Maker(99)
    pages = [maker.page() for _ in range(30)]
    bare = [p.replace(' data-y="1"', "").replace(' data-y="0"', "") for p in pages]
    same = sum(a == b for a, b in zip(extractor.texts(pages), extractor.texts(bare)))
    assert same >= 24  # a marked inline element is a node even if its class says nothing
