"""Blocks of broken pages: no text behind a broken form is lost."""

import time

import numpy as np
import pytest

from corpusloom.llm import html_lstm
from corpusloom.llm.html_blocks import Block, Paths, blocks_of

PAGE = "<article><p>one {} two</p><p>three</p></article><footer>end</footer>"


def texts(page):
    return [b.text for b in blocks_of(page, Paths())]


@pytest.mark.parametrize("form, first", [
    ("<svg viewBox='0'>", "one two"), ("<noscript><img>", "one two"), ("<template>", "one two"), ("<iframe src=x>", "one two"), ("<title>", "one two"), ("<textarea>", "one two"),
    ("<!-->", "one two"), ("<!--->", "one two"), ("<!-- a --!>", "one two"), ("<!-- a > b -->", "one two"), ("<!-- never ended >", "one two"),
    ("<object data=x>fallback</object>", "one fallback two"), ("<math><mi>x</mi></math>", "one x two"), ("<xmp><b>&amp;</b></xmp>", "one <b>&amp;</b> two"),
    ("<svg><svg>in</svg><text>t</text></svg>", "one two"), ("<noscript><p>hidden</p></noscript>", "one two"), ("<template><svg></template>", "one two"), ("<svg/>", "one two"),
    ("<script>if (a</b) '<svg>'</script>", "one two"), ("&<b>amp;</b>", "one &amp; two"), ("&amp;lt;", "one &lt; two"), ('<img alt="a>b <p>c">', "one two"),
])
def test_broken_forms_inside_an_article(form, first):
    assert texts(PAGE.format(form)) == [first, "three", "end"]


def test_an_element_left_open_by_its_block_hides_nothing():
    assert texts("<div><p>a<svg><text>b</text></p><p>c</p></div><div>d<svg>e</svg></div>") == ["ab", "c", "d"]
    assert texts("a<noscript>b<noscript>c</noscript>d") == ["abd"]
    assert texts("<p>a<script>b") == ["a"]


@pytest.mark.parametrize("page", ["<svg>" * 20_000, "<!--" * 50_000, "<p><noscript>" * 20_000, "<title>" * 20_000, "<p>" * 50_000 + "</div>" * 50_000])
def test_pages_of_broken_markup_take_linear_time(page):
    began = time.process_time()
    assert texts(page + "<p>end")[-1].endswith("end")
    assert time.process_time() - began < 5


def test_all_words_of_a_block_count():
    words = [f"w{i}" for i in range(500)]
    whole = html_lstm.word_vector(Block(0, " ".join(words), 0))
    assert np.isclose(np.linalg.norm(whole[: html_lstm.WORD_SIZE]), 1)
    counts = np.bincount([html_lstm._bucket(w, html_lstm.WORD_SIZE) for w in words], minlength=html_lstm.WORD_SIZE)
    assert np.allclose(whole[: html_lstm.WORD_SIZE], counts / np.linalg.norm(counts))
