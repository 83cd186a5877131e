"""Pages of one host that were made by different templates."""

from stopwise.llm import html_text


def test_every_template_of_a_host_has_text(spark):
    def div(t, more=""):
        return f"<body><nav>Menu</nav><div class=top>Same</div><div><p>{t}</p>{more}</div></body>"

    rows = [
        (1, "http://a.org/1", "<body><nav>Menu</nav><article><p>in article</p></article></body>"),
        (2, "http://a.org/2", "<body><nav>Menu</nav><div class=content><p>in content</p></div></body>"),
        (3, "http://b.org/1", div("one")),
        (4, "http://b.org/2", div("two", "<table><tr><td>only here</table>")),
        (5, "http://c.org/1", "<html class=nav><body class='has-sidebar'><p>beside</p></body></html>"),
        (6, None, "<body><main><p>no url</p></main></body>"),
        (7, "nothing", "<body><p>no host</p></body>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {
        1: "in article", 2: "in content", 3: "one", 4: "two\n\nonly here", 5: "beside", 6: "no url", 7: "no host",
    }
