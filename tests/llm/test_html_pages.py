"""Main text of malformed and large pages."""

import time

import pytest

from tidemark.llm import html_text
from test_llm_operators import _LONG

MANY = 40_000


@pytest.mark.parametrize("page", ["<p>x" * MANY + "</b>" * MANY, "<div class=post>some text " * MANY, "<div class=advert>some text " * MANY, "<header>" * MANY + "</nav>" * MANY, "<p a=\"" * MANY, "<a b ' c" * MANY])
def test_malformed_pages_take_linear_time(page):
    begin = time.perf_counter()
    html_text.main_text(page[: len(page) // 4])
    quarter, begin = time.perf_counter() - begin, time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - begin < 8 * max(quarter, 0.05)


@pytest.mark.parametrize("spaces", [0, 1, 15, 20, 5000])
def test_values_far_from_their_name(spaces):
    value = "<b>not text</b>" * 1000
    assert html_text.main_text(f'<p data-x={" " * spaces}"{value}">{_LONG}</p>') == _LONG


def test_running_text_in_an_element_of_an_unclear_name():
    social = "Social mobility rose sharply in the sample, and more so in the second half of it, as the table shows."
    page = f'<article><p>{_LONG}</p><div class="note social"><p>{social}</p></div><p>{_LONG}</p><div class="social">Share this: One Two Three</div><div class="advert">{_LONG}</div></article>'
    assert html_text.main_text(page) == f"{_LONG} {social} {_LONG}"


def test_nested_articles_stay_with_the_outer_one():
    inner = f"<section class=content><p>{_LONG}</p><section class=text><p>{_LONG} Again.</p></section></section>"
    assert html_text.main_text(f"<div class=post><p>Short.</p>{inner}</div><p>outside</p>") == f"{_LONG} {_LONG} Again."
