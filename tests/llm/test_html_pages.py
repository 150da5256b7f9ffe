"""Main text of pages in which no article element decides: generated ones with known text, and the cases that once lost their article."""

import random
import re

import pytest

from palimpsest.llm import html

SF = "/root/testdata/sf0.01"


def say(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "kappa", "omega"]) + rng.choice(["", "", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def weights(spark):
    return html.fitted(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.fixture(scope="module", params=["default", "fitted"])
def either(request, weights):
    return html.Weights() if request.param == "default" else weights


BODY = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single no-sidebar"><div class="entry"><p>{}</p></div></body>',
        '<body class="has-sidebar with-menu sidebar-right"><div class="entry"><p>{}</p></div></body>',
        '<body class="newsletter"><div><p>{}</p></div></body>',
        '<article class="post category-newsletter tag-ads"><p>{}</p></article>',
        '<main class="page with-sidebar" id="sidebar"><p>{}</p></main>',
        "<body><form id=f><p>{}</p></form></body>",
        '<body><form id=f action="x"><input name=a><div class="layout-sidebar"><p>{}</p></div></form></body>',
        "<main><article><p>{}</p></article><div id=comments><article>reader says hi</article></div></main>",
        '<main><article><p>{}</p></article><article class="comment" id="comment-12"><p>reader says hi</p></article></main>',
        '<article><p>{}</p></article><aside><article><p>related teaser text</p></article></aside>',
        '<div class="sidebar-wrap"><p>{}</p></div><div class="sidebar"><ul><li><a href=x>more</a></li></ul></div>',
        '<div><form><input><label>search here</label></form><p>{}</p></div>',
        '<article><p>{}</p><form><p>your name and address please</p></form></article>',
        '<article><header><h2></h2></header><p>{}</p><div class="ad">buy this thing</div></article>',
    ],
)
def test_names_and_forms_do_not_lose_the_article(either, page):
    assert html.main_text(page.format(BODY), either) == BODY


def generated(rng, i):
    """(page, text): no content element; bars, lists of links, notices and comments around paragraphs."""
    blocks = [say(rng, rng.randint(15, 80)) for _ in range(rng.randint(3, 8))]
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{say(rng, 2)}</a></li>' for k in range(n)) + "</ul>"
    inner = "".join(f"<p>{b.replace('alpha', '<a href=z>alpha</a>', 1)}</p>" for b in blocks)
    title = say(rng, 5)
    story = f'<div class="{rng.choice(["entry", "story-body", "x1", "post category-newsletter"])}"><h1>{title}</h1>{inner}</div>'
    if i % 3 == 0:
        story = f"<form method=post><input type=hidden name=v>{story}</form>"
    if i % 4 == 1:
        story = f'<div class="{rng.choice(["page-with-sidebar", "sidebar-layout", "content-sidebar-wrap"])}">{story}<div class="sidebar">{links(5)}</div></div>'
    after = f'<div class="comments"><div class="comment"><p>{say(rng, 12)}</p></div></div>' if i % 2 else ""
    page = f'<html><body class="{rng.choice(["single no-sidebar", "has-sidebar", "home newsletter-open", ""])}"><div class="{rng.choice(["menu", "top-bar", "q"])}">{links(rng.randint(4, 12))}</div>{story}{after}<div class="cookie-notice">{say(rng, 9)}</div><footer>{links(4)}</footer></body></html>'
    return page, "\n\n".join([title, *blocks])


def test_generated_pages_give_their_text(either):
    rng = random.Random(7)
    pages = [generated(rng, i) for i in range(80)]
    assert [html.main_text(page, either) for page, _ in pages] == [text for _, text in pages]


def test_given_pages_with_their_markup_hidden(spark, weights):
    """Without the element that names the article the scan alone finds the same text."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    hidden = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    same = sum(html.main_text(a, weights) == html.main_text(b, weights) for a, b in zip(pages, hidden, strict=True))
    assert same >= 0.98 * len(pages)
