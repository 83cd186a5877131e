"""Urls that hold a second ://."""

from stopwise.llm import url_filter


def test_path_is_behind_the_first_host(spark):
    rows = [
        (1, "http://shop.net?u=http://b.org/es/x", "shop.net", "", "allow"),
        (2, "http://shop.net#http://b.org/es/x", "shop.net", "", "allow"),
        (3, "http://shop.net/es/?u=http://b.org/x", "shop.net", "/es/", "block"),
        (4, "http://shop.net", "shop.net", "", "allow"),
        (5, "shop.net/es/", "", "", "allow"),
        (6, "http://shop.net/es/\n", "shop.net", "/es/\n", "block"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {r[0]: r[2:] for r in rows}
