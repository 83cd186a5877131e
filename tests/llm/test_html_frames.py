"""Frames that are none, hard pages, and the given pages against a plain parser."""

import time
from html.parser import HTMLParser

import pytest

from stopwise.llm import html_text

LONG = "words of the page that are its text " * 10
TEXT = LONG.strip()


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    return [got[i] for i in range(len(pages))]


def test_names_of_frames_are_hints(spark):
    pages = [
        f'<body><article class="post category-social"><p>{LONG}</p></article></body>',
        f'<body><div id="wrapper" class="has-sidebar"><article><p>{LONG}</p></article></div></body>',
        f'<body><div class="sidebar-right"><main class="no-sidebar"><p>{LONG}</p></main></div></body>',
        f'<body><div id="content" class="comment-open"><p>{LONG}</p></div></body>',
        f'<body><form action=x><nav>menu</nav><div><p>{LONG}</p></div></form><footer>f</footer></body>',
        f'<body><article class="comment"><p>{LONG}</p></article></body>',
        f'<body><div class="widget"><p>{LONG}</p></div></body>',
    ]
    assert texts(spark, pages) == [TEXT] * len(pages)


def test_frames_go(spark):
    framed = (
        '<div class="ad-slot">Buy</div><div class="cookie-banner">We bake</div><div id="newsletter-signup">Mail</div>'
        '<div role="navigation">Go</div><div class="site-footer">Foot</div><div class="siteHeader header">Head</div>'
    )
    inside = '<form>Name</form><div class="share-buttons">Share</div><aside>Side</aside><p hidden>no</p>'
    comments = f'<section class="comments"><article class="comment"><p>Nice! {LONG * 3}</p></article></section>'
    pages = [
        f"<body>{framed}<article><p>{LONG}</p>{inside}</article></body>",
        f"<body><article><p>{LONG}</p></article>{comments}</body>",
        f"<body><article><p>{LONG}</p>{comments}</article></body>",
        "<body><nav>only a menu</nav><footer>and a footer</footer></body>",
    ]
    assert texts(spark, pages) == [TEXT, TEXT, TEXT, ""]


def test_long_text_beside_a_teaser(spark):
    (got,) = texts(spark, [f'<body><article>Teaser</article><div class="x"><p>{LONG}</p></div></body>'])
    assert got == f"Teaser\n\n{TEXT}"


def test_deep_and_long_pages(spark):
    inner = f"<p>{LONG}</p>"
    same = "<div>" * 5000 + inner + "</div>" * 5000
    mixed = "<div class=a><section>" * 2500 + inner + "</section></div>" * 2500
    kinds = ["<p>%d</p>", "<h2>%d</h2>", "<ul><li>%d<li>b</ul>", "<blockquote>%d</blockquote>", "<pre>%d</pre>"]
    many = "".join(kinds[(k * k + k // 7) % 5] % k for k in range(20_000))
    start = time.time()
    got = texts(spark, [f"<body>{p}</body>" for p in (same, mixed, inner + mixed, many)])
    assert got[:3] == [TEXT, TEXT, f"{TEXT}\n\n{TEXT}"]
    numbers = [b for b in got[3].split("\n\n") if b != "b"]
    assert numbers == [str(k) for k in range(20_000)]
    assert time.time() - start < 120


class Plain(HTMLParser):
    """Blocks of article elements outside of frames."""

    INLINE = set("a b br i em strong span code small sub sup u script".split())
    FRAMES = set("nav aside footer form script style header".split())

    def __init__(self, page):
        super().__init__()
        self.article = self.frames = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        if name not in self.INLINE:
            self.blocks.append("")
        elif name == "br":
            self.blocks[-1] += " "
        self.article += name == "article"
        self.frames += name in self.FRAMES or ("class", "ad") in attrs

    def handle_endtag(self, name):
        if name not in self.INLINE:
            self.blocks.append("")
        self.article -= name == "article"
        self.frames -= name in self.FRAMES

    def handle_data(self, data):
        if self.article and not self.frames:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    got = html_text.op3_html_text(spark, f"/root/testdata/{sf}").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id] or ""
        # the one class of frames there is; it holds no elements
        page = page.replace('<div class="ad">', "<aside>").replace("</div>", "</aside>")
        assert r.text == Plain(page).text()
        assert r.n_chars == len(r.text) > 0
