"""Pages that are deep, broken or made to be costly."""

from __future__ import annotations

import time

import pytest

from bidlake.llm.htmltext import render

MANY = 100_000
COSTLY = {
    "nested divs": ("<div>" * MANY + "x", "x"),
    "nested and closed": ("<div><p>" * MANY + "x" + "</p></div>" * MANY, "x"),
    "stray ends": ("<b>" * MANY + "</i>" * MANY + "x", "x"),
    "stray ends of cells": ("<table><tr><td>" + "<b>" * MANY + "</td2>" * MANY + "x", "x"),
    "paragraphs in a deep stack": ("<span>" * MANY + "<p>y" * MANY, "y"),
    "list in list": ("<ul><li>" * (MANY // 10) + "x", "x"),
    "cells of a row": ("<table><tr>" + "<td>y" * MANY, "y"),
    "reaching cells": ("<table><tr>" + "<td rowspan=9>y" * 3000 + ("<tr>" + "<td>z" * 3000) * 3, "y"),
}


@pytest.mark.parametrize("name", COSTLY)
def test_costly_pages_end_soon(name):
    html, shown = COSTLY[name]
    began = time.thread_time()
    assert shown in render(html)[1]
    assert time.thread_time() - began < 10


def test_list_starts():
    shown = lambda start: render(f"<ol start={start}><li>a</ol>")[1]
    assert [shown(x) for x in ("5", "-3", "+4", "²", "٣", "9" * 5000, "7up", "''", "x")] == ["5. a", "-3. a", "4. a", "1. a", "1. a", "1. a", "7. a", "1. a", "1. a"]


@pytest.mark.parametrize("rest", ["<!-- b", "<!DOCTYPE <x", "<?php b", "<a href='b", "</di", "<![CDATA[b", "<x"])
def test_what_is_not_ended_shows_nothing(rest):
    assert render(f"<p>a {rest}")[1] == "a"
    assert render(rest)[1] == ""


def test_spans_without_text_take_no_room():
    row = "<tr><td colspan=1000>a</td><td>b</td></tr>"
    text = render(f"<table>{row * 800}</table>")[1]
    assert text.split("\n")[0] == "a | b" and len(text) < 6 * 800
    assert render("<table><tr><td>a<td><td>b<tr><td>c<td><td>d</table>")[1] == "a | b\nc | d"
    assert render("<table><tr><td>a<td>bb<td>c<tr><td colspan=2>dd<td>e</table>")[1] == "a | bb | c\ndd     | e"
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")[1] == "a | b\n  | c"


def test_ends_inside_cells_stay_inside():
    assert render("<div>a<table><tr><td>b</div>c</td><td>d</td></table>e")[1] == "a\n\nbc | d\n\ne"
