"""Operators on web pages, the pipeline, and the queries against their SQL at the smallest scale."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from stopwise.llm import html_text, plans, url_filter  # noqa: E402

from tools.check import TABLES, rows_of, same  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), (g, w)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x1">
<nav><ul><li><a href=/a>Menu</a><li>More</ul></nav><!-- <p>no</p> --><header>Site</header>
<div class='ad slot'>Buy</div><article id=a7><h1>A &amp; B</h1><p>One <b>two
 three<br>four<p>Five&nbsp;six &lt;tag&gt;<ul><li>item<li>other</ul>
<script>document.write("</article><p>never</p>")</script><aside>side</aside>
<form><p>Name</p></form><div class="comments"><p>First!</p></div></article>
<footer>&copy; host</footer></body></html>"""
TEXT = "A & B\n\nOne two three four\n\nFive six <tag>\n\nitem\n\nother"


def test_main_text(spark):
    rows = [
        (1, "http://h.com/1", PAGE, "t", "m"),
        (1, "http://h.com/1", PAGE, "t", "m"),
        (2, "http://H.com/2", PAGE.replace("<p>Five", "<table><tr><td>cell</table><p>Five"), "t", "m"),
        (3, "http://h.com/3", PAGE[: PAGE.index("</body")], None, None),
        (4, None, None, None, None),
        (5, "nothing", "", None, None),
        (6, "http://plain.org/", "<body><div>Top</div><p>first text</p></body>", None, None),
        (7, "http://plain.org/", "<body><div>Top</div><p>other text</p><p>and more</p></body>", None, None),
        (8, "http://cut.org/", PAGE[: PAGE.index("<br>") + 2], None, None),
        (9, "http://none.org/", "just words", None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, main string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == TEXT and by[1].n_chars == len(TEXT) and by[1].main == "m"
    assert by[2].text == TEXT.replace("Five", "cell\n\nFive")
    assert by[3].text == TEXT
    assert by[4].text == "" and by[4].n_chars == 0 and by[5].text == ""
    assert by[6].text == "first text" and by[7].text == "other text\n\nand more"
    assert by[8].text == "A & B\n\nOne two three"
    assert by[9].text == "just words"
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_expressions():
    def shape(nodes):
        return "".join(
            ("#" if a == "#" else f"({shape(c)})" if a == "()" else f"{a}[{shape(c)}]") + ["", "?", "+", "*"][q]
            for a, q, c in nodes
        )

    def page(labels):
        return html_text.expression([(("b", x), (0, i + 1)) for i, x in enumerate(labels)])

    assert shape(page("ppp")) == "b[p[#]+]"
    assert shape(page("hphphp")) == "b[(h[#]p[#])+]"
    assert shape(html_text.merged(page("hp"), page("hpp"))) == "b[h[#]p[#]+]"
    assert shape(html_text.merged(page("hp"), page("hdp"))) == "b[h[#]d[#]?p[#]]"
    assert shape(html_text.merged(page("h"), page("d"))) == "b[h[#]?d[#]?]"


def test_many_expressions_of_a_host(spark):
    labels = ["p", "h", "d", "q", "u"]
    rows = [
        ("x", html_text.packed(html_text.expression([(("b", labels[int(c)]), (0, i + 1)) for i, c in enumerate(f"{n:b}")])))
        for n in range(1, 400)
    ]
    df = spark.createDataFrame([*rows, ("y", rows[0][1])], "host string, wrapper string")
    got = {r.host: html_text.unpacked(r.wrapper) for r in html_text.host_wrappers(df, fan_in=4).collect()}
    assert set(html_text.slots(got["x"])) == {("b", "p"), ("b", "h")}
    assert got["y"] == html_text.unpacked(rows[0][1])


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 30_000, np.int64)
    universe = spark.createDataFrame([(int(k),) for k in keys[:25_000]], "h long")
    listed = spark.createDataFrame([(int(k),) for k in keys[22_000:]], "h long")
    cascade = url_filter.build_cascade(listed, universe, bits_per_key=4)
    assert len(cascade.levels) > 2
    assert not cascade.listed(keys[:22_000].view(np.uint64)).any()
    assert cascade.listed(keys[22_000:].view(np.uint64)).all()


def test_cascade_parts_keys_that_collide(spark):
    # equal but for two bits that one filter's cells do not read
    keys = [12345, 12345 ^ (1 << 31), 12345 ^ (1 << 32)]
    listed = spark.createDataFrame([(keys[0],)], "h long")
    universe = spark.createDataFrame([(k,) for k in keys], "h long")
    cascade = url_filter.build_cascade(listed, universe)
    assert cascade.listed(np.array(keys, np.int64).view(np.uint64)).tolist() == [True, False, False]


def test_cascade_fails_when_its_filters_are_too_small(spark):
    listed = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    universe = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    with pytest.raises(RuntimeError, match="do not fit"):
        url_filter.build_cascade(listed, universe, limit_bytes=4096, tries=2)
    empty = listed.limit(0)
    assert not url_filter.build_cascade(empty, universe.limit(50)).listed(np.arange(5, dtype=np.uint64)).any()


def test_urls(spark):
    urls = [
        "http://www.example.com/en/1", "http://EXAMPLE.com/en/?x=/fr/", "https://a.example.com/en/", "http://b.net/fr/x",
        "http://net/es/", "http://b.net/de/", "http://xnet/es/", "http://other.org/en/", "http://example.com", None, "",
        "no scheme", "a://b://c.com/", "http://example.com?q=/en/", "http://example.com#/en/", "://x.com/a/b#c", "http://a.com/x\ny",
        "http://shop.net?u=http://b.org/es/x", "http://shop.net#http://b.org/fr/", "http://shop.net/es/?u=http://b.org/x",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(r.page_id, r.url) for r in pages.collect()])
    want = con.sql(url_filter.OP5_SQL).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len(got) == len(urls) + 1
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    bare = url_filter.judge_urls(pages, rules.limit(0), default="block").collect()
    assert {r.verdict for r in bare} == {"block"} and {r.rule for r in bare} == {None}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        path = f"{corpus_pipeline.staged.__globals__['new_path'](spark, 'test-' + name)}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "sharding":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert 0.5 * before < docs.count() <= before
            assert docs.where("doc_id IS NULL").count() == 1
    slots = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d"))
    assert slots.where("n <> m + 1 OR n <> d").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty, SF).count() == 0
