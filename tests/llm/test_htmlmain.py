"""Broken markup in very long pages."""

import time

import pytest

from lorefield.llm import htmlmain


def words(page):
    return [w for b in htmlmain.blocks_of(page) for w in b.words]


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a b="' * 100_000, "x > " + "<a " * 300_000])
def test_tags_that_never_end_take_linear_time(page):
    began = time.time()
    assert words(page)
    assert time.time() - began < 5


def test_the_end_of_a_cut_off_page():
    assert words("<p>one</p> two <b") == ["one", "two", "<b"]
    assert words("<p>one</p> two <!-- three > four") == ["one", "two"]
    assert words("<p>one</p> two <!-- three") == ["one", "two"]
    assert words("<p>one</p> two <!doctype three") == ["one", "two"]
    assert words("<p>one</p> <![CDATA[two") == ["one", "two"]
    assert words("<!--> one") == []
