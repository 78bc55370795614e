"""Operator 3 on broken markup: no exception, linear time."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.html_regions import main_text

PARTS = ["<", ">", "!", "[", "]", "-", "--", '"', "'", "a", "b", " ", "=", "/", "&", "#", "CDATA", "<p>", "</p>", "<![", "<!--", "-->", "script", "?", "\n", "<article>", "</div>"]


@settings(deadline=None, max_examples=2000)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_no_page_fails(html):
    assert isinstance(main_text(html), str)


@pytest.mark.parametrize(("html", "text"), [("<p>a</p><![ if !IE]><p>b</p>", "a b"), ("<![>", ""), ("<p>x</p><![foo><p>y</p>", "x y"), ("<![1]>", ""), ("<p>word</p><![", "word"), ("<p>one</p><!-- x", "one"), ("a < b <c", "a < b"), ("<p>a</p><![CDATA[ x > y ]]><p>b</p>", "a b")])
def test_broken_sections(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("part", ["<a b=", "<!-- ", '<a b="', "<![", "</", '<a "', "<!["])
def test_time_is_linear(part):
    began = time.time()
    main_text(part * 40_000)
    main_text(part * 40_000 + ">")
    assert time.time() - began < 5
