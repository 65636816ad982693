"""Rows at the edges of their rules, where queries once differed from the SQL that states them."""

from leafmill.operators import detect
from leafmill.operators.nodes import dom_nodes
from leafmill.plans import registry


def _pages(spark, folder, htmls):
    spark.createDataFrame([(k, f"https://a.b/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_paragraph_of_200_characters_that_begins_with_by(spark, tmp_path):
    texts = [("By the thint " + "a" * n)[:n] for n in (199, 200, 201)] + [" " * 500 + "By the thint", "x. Leave a Reply"]
    d = _pages(spark, tmp_path, [f"<article><h1>T</h1><p>{t}</p></article>" for t in texts])
    found = {r["page_id"]: r["issues"] for r in registry.detectors_all(spark, d).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}
    assert detect.scan(dom_nodes(spark.read.parquet(f"{d}/pages.parquet"), "page_id")).count() == 1


def test_titles_with_cut_and_other_references(spark, tmp_path):
    heads = ["a&amp;&amp", "b &quot;c&quot;", "d&&amp;e", "&amp;quot; &lt;f", "g &am"]
    d = _pages(spark, tmp_path, [f"<html><head><title>{h} - Blog</title></head><body><article><h1> {h} </h1><p>x</p></article></body></html>" for h in heads])
    found = {r["page_id"]: r["title"] for r in registry.page_title(spark, d).collect()}
    assert found == {0: "a&&amp", 1: "b &quot;c&quot;", 2: "d&&e", 3: "&quot; &lt;f", 4: "g &am"}
