"""Ratios decide which regions are content; classes alone never drop one."""

import re

import pytest
from claimlens.llm import html_text

SF = "/root/testdata/sf0.001"
STORY = "".join(f"<p>{'A sentence of the story that is long enough to be read. ' * k}</p>" for k in (3, 1, 4))
TEXT = "\n\n".join(("A sentence of the story that is long enough to be read. " * k).strip() for k in (3, 1, 4))
MENU = "<nav><a href=a>One</a><a href=b>Two</a></nav>"
LINKS = "<div><ul>" + "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(8)) + "</ul></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<article>{STORY}</article></body>",
        f"<body><div class='page has-sidebar'>{MENU}<div>{STORY}</div></div></body>",
        f"<body><div class='page has-sidebar share'><h1>Short head</h1>{STORY}</div></body>",
        f"<body>{MENU}<div class='article-share-wrap'><article>{STORY}</article></div></body>",
        f"<body>{MENU}{LINKS}<div class='article-share-wrap'>{STORY}</div>{LINKS}</body>",
        f"<body>{MENU}<div>{STORY}</div>{LINKS}</body>",
        f"<body>{MENU}<main><div>{STORY}</div><div class='related'><p>Other</p><p>More</p></div></main></body>",
        f"<body><article>{STORY}<section class='comments'><p>I agree with this.</p><p>So do I, very much.</p></section></article><footer>{'Words of the footer. ' * 40}</footer></body>",
        f"<body><article>{STORY}</article><div>A short notice of something else.</div></body>",
    ],
)
def test_story_comes_out_whole(page):
    assert html_text.main_text(page).removeprefix("Short head\n\n") == TEXT


def test_without_the_ratio_regions_are_mistaken(monkeypatch):
    page = f"<body>{MENU}{LINKS}<div>{STORY}</div>{LINKS}</body>"
    assert html_text.main_text(page) == TEXT
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: [1.0] * len(ratios))
    assert html_text.main_text(page) != TEXT


def test_pages_without_their_article_element(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()
    assert rows
    for (html,) in rows:
        want = html_text.main_text(html)
        bare = re.sub("<article>", "<div>", html).replace("</article>", "</div>")
        assert html_text.main_text(bare) == want
        if len(want) >= 100:  # a shorter one may lose to an advert that nothing marks
            assert html_text.main_text(bare.replace('<div class="ad">', "<div>")) == want
        assert html_text.main_text(html.replace("<body>", "<body><div class='page has-sidebar share'>")) == want
