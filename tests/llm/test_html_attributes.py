"""Article text isn't lost through names and words of attributes; deep and wide pages don't end a task."""

import pytest

from slopewatch.llm import html_text


@pytest.mark.parametrize(
    "part",
    ['<p title="the hidden valley">X</p>', '<p data-hidden-date="x">X</p>', '<p data-role="form">X</p>', '<p class="social">X</p>', '<div class="notice">X</div>', "<p title='role=form class=ad'>X</p>", '<p title="a" data-x=hidden>X</p>', '<li id="nav">X</li>'],
)
def test_article_text_stays(part):
    assert html_text.main_text(f"<body><nav><a href=x>menu</a></nav><article><h1>T</h1>{part}<p>Second.</p></article></body>", None) == "T\nX\nSecond."


@pytest.mark.parametrize("part", ['<p hidden>X</p>', '<p role="form">X</p>', '<div class="big ad">X</div>', '<section id="comments"><p>X</p></section>', "<p style='display: none'>X</p>", '<aside>X</aside>', '<div aria-hidden="TRUE">X</div>', "<form><p>X</p></form>"])
def test_other_parts_go(part):
    assert html_text.main_text(f"<body><article><h1>T</h1>{part}<p>Second.</p></article></body>", None) == "T\nSecond."


def test_deep_and_wide_pages_align_to_themselves():
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(html_text.RECURSION)
    try:
        source = ("<div>" + "<b>x</b>" * 31) * 4000 + "</div>" * 4000
        page, wrapper = (html_text.parse(source) for _ in range(2))
        html_text.numbered(page)
        html_text.numbered(wrapper)
        assert len(html_text.aligned(page, wrapper)) == 1 + 4000 * 32
    finally:
        sys.setrecursionlimit(before)


def test_attributes_are_parsed_whole():
    node = html_text.Node("p", """ CLASS='a b' data-x = "role=form" hidden id=z id=y broken="no end""", None)
    assert html_text.attribute(node) == {"class": "a b", "data-x": "role=form", "hidden": "", "id": "z", "broken": "no end"}
