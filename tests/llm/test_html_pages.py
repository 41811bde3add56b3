"""Pages in which neighbours decide, and markup as it is found in the wild."""

import time

import pytest
from pyspark.sql import functions as F

from sharewise.llm import html

LONG = "A paragraph of an article that goes on for quite a while, with more than one clause in it."
LINKS = "".join(f"<div><a href=/{i}>Place {i}</a></div>" for i in range(4))


def labels(page):
    found = html.blocks(page)
    kept = html.minimum_cut([b.odds for b in found.blocks], html.edges(found))
    return [(b.text, b.odds > 0, keep) for b, keep in zip(found.blocks, kept, strict=True)]


SHORT_BETWEEN = f"<body><div>{LONG}</div><div>He paused</div><div>{LONG}</div></body>"
LINE_AMONG_LINKS = f"<body><section>{LINKS}<p>Our best offers today!</p>{LINKS}</section><p>{LONG}</p></body>"


def test_a_short_line_between_paragraphs_stays():
    assert labels(SHORT_BETWEEN)[1] == ("He paused", False, True)
    assert html.main_text("<body><div>He paused</div></body>") == ""


def test_a_line_among_links_goes():
    found = {text: rest for text, *rest in labels(LINE_AMONG_LINKS)}
    assert found["Our best offers today!"] == [True, False]
    assert html.main_text(LINE_AMONG_LINKS) == LONG


def test_the_cut_changes_labels():
    changed = sum(alone != kept for page in (SHORT_BETWEEN, LINE_AMONG_LINKS) for _, alone, kept in labels(page))
    assert changed == 2


PAGES = [
    SHORT_BETWEEN,
    f"<div>x</div>{LINKS}<p>{LONG}</p><div class=author-box>By A. Body</div>",
    f"<article><p>{LONG}<aside>More</aside><p>Yes.</article><footer>Imprint</footer>",
    f"<table><tr><td>1<td>2<tr><td>{LONG}</table><div class=ad>Buy</div>",
]


@pytest.mark.parametrize("page", PAGES)
def test_whole_page_has_the_cheapest_labelling(page):
    found = html.blocks(page)
    odds, links = [b.odds for b in found.blocks], html.edges(found)
    assert 2 < len(odds) <= 12 and len(links) >= len(odds) - 1

    def cost(keep):
        own = sum(max(0, o) if not k else max(0, -o) for o, k in zip(odds, keep, strict=True))
        return own + sum(w for a, b, w in links if keep[a] != keep[b])

    best = min(([m >> i & 1 == 1 for i in range(len(odds))] for m in range(1 << len(odds))), key=cost)
    assert html.main_text(page) == "\n\n".join(
        b.text for b, keep in zip(found.blocks, best, strict=True) if keep
    )


@pytest.mark.parametrize(
    "start", ["<p data-x=it's>", "<p title='a>b'>", '<p title = "it\'s">', "<p a=>", "<p x=\"1\" y=a'b\"c>"]
)
def test_quotes_in_attributes(start):
    page = f"<article>{start}{LONG}</p><p>It's the second one, with words enough.</p></article>"
    text = html.main_text(page)
    assert text.endswith("It's the second one, with words enough.") and LONG in text


def test_unquoted_address_with_a_slash_is_a_link():
    assert html.main_text("<div><a href=/a/>All of the pages of this place</a></div>") == ""


HIDDEN = [
    "hidden", "HIDDEN=''", "aria-hidden=true", 'style="color:red; display : none"',
    "style='visibility:hidden'", 'class="x" hidden',
]


@pytest.mark.parametrize("mark", HIDDEN)
def test_hidden_text_is_no_article(mark):
    page = f"<article><p>{LONG}</p><div {mark}><p>Not shown {LONG}</p></div><p {mark}>Nor this {LONG}</p></article>"
    assert html.main_text(page) == LONG


@pytest.mark.parametrize("mark", ["aria-hidden=false", "data-hidden", "class=hidden-gem", "style=color:red"])
def test_other_marks_hide_nothing(mark):
    assert html.main_text(f"<article {mark}><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("name", ["related-work", "search-results-text", "story notice-of-award-text", "data"])
def test_names_that_only_mention_boilerplate_keep_text(name):
    assert html.main_text(f'<article><div class="{name}"><p>{LONG}</p></div></article>') == LONG


@pytest.mark.parametrize("name", ["article-comments", "site-footer", "cookie-notice-wrapper", "nav_list", "ad"])
def test_names_of_boilerplate_drop_text(name):
    page = f'<article><p>{LONG}</p></article><div id="{name}"><p>Other {LONG}</p></div>'
    assert html.main_text(page) == LONG


@pytest.mark.parametrize("tag", ["div", "b", "span", "li"])
def test_deep_pages_take_time_in_proportion(tag):
    def took(n):
        page = "".join(f"<{tag}>word {i} " for i in range(n)) + LONG
        start = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - start

    took(500)
    assert took(32_000) < 40 * max(took(4000), 0.02)


def test_column_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p"), (5, "&amp"), (5, "&amp"), (6, f"<p>{LONG}"), (7, "</div>" * 9)]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    df = df.withColumns({c: F.lit("x") for c in ("text", "url", "n_chars")})
    found = df.select("page_id", "text", html.extract("html").alias("t")).collect()
    assert [r.t for r in found] == ["", "", "", "", "", "", LONG, ""]
    assert {r.text for r in found} == {"x"}
    assert df.filter("false").select(html.extract("html")).collect() == []
