import time

import pytest

from ledgerloom.llm import html_text

LARGE = {
    "divisions": "<div>x" * 40_000, "crossed": "<b>x</i>" * 30_000, "lists": "<ul><li>x" * 28_000, "masks": "<svg>" + "<mask>" * 40_000, "quotes": "<blockquote>x" * 19_000,
    "spans": "<table><tr>" + "<td colspan=1000>x" * 14_000, "long cell": "<table><tr><td>" + "y" * 5000 + "<tr><td>a<td>b" * 15_000,
}


@pytest.mark.parametrize("name", LARGE)
def test_time_and_text_grow_with_the_page(name):
    html = LARGE[name]
    began = time.time()
    text = html_text.render(html)
    assert time.time() - began < 8 and len(text) < 6 * len(html)
    if name != "masks":
        assert text.count("x") == html.count("x") and text.count("y") == html.count("y")


def test_indentation_ends_and_columns_are_where_cells_begin():
    deep = html_text.render("<ul><li>" * 30 + "end")
    assert deep.split("\n")[-1].endswith("- end") and len(deep.split("\n")[-1]) <= html_text.DEEPEST + 5
    assert html_text.render("<table><tr><td>a<td colspan=9>b<td>c<tr><td>aa<td>bb<td>cc").split("\n") == ["a   b       c", "aa  bb  cc"]
    assert html_text.render("<table><tr><td colspan=2>wide<td>c<tr><td>1<td>2<td>3").split("\n") == ["wide  c", "1  2  3"]
