"""Trees, detectors, rewrites and conversion on small pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import dom, rewrite
from leafmill.operators import detect, pages
from leafmill.operators.nodes import dom_nodes

SNIPPETS = [
    ('<img src="data:image/gif;base64,R0" alt="x">', "data_placeholder", "ERROR", 1),
    ('<noscript><img src="https://a.b/c.png"></noscript>', "noscript_remnant", "WARN", 1),
    ('<img src="https://a.b/c.png">', "external_image", "WARN", 1),
    ('<img src="https://a.b/c.png" width="1" height="1">', "external_image", "WARN", 0),
    ('<img src="https://a.b/c.png" width="1" height="1">', "tracking_pixel", "WARN", 1),
    ('<img src="https://pixel.wp.com/g.gif">', "tracking_pixel", "WARN", 1),
    ('<iframe></iframe>', "empty_embed", "ERROR", 1),
    ('<iframe data-src="https://v.w/x"></iframe>', "empty_embed", "WARN", 1),
    ('<script src="https://gist.github.com/u/1.js"></script>', "unreplaced_gist", "ERROR", 1),
    ('<div class="sharedaddy">Share it</div>', "wordpress_chrome", "WARN", 1),
    ("<p>Leave a Reply</p>", "wordpress_chrome", "WARN", 1),
    ("<p>The following diagram shows it</p><p>text</p>", "missing_image_signal", "WARN", 1),
    ('<p>The following diagram shows it</p><img src="a.png">', "missing_image_signal", "WARN", 0),
    ("<p><b>bold</b>text</p>", "md_notation_in_text", "WARN", 1),
    ("<p><b>bold</b> text</p>", "md_notation_in_text", "WARN", 0),
    ("<pre><code>&lt;table&gt;</code></pre>", "suspicious_code_content", "WARN", 1),
    ('<a href="https://imgur.com/a">x</a>', "imgur_image", "WARN", 1),
    ("<table><tr><td><pre>1\n2</pre></td><td><pre>a\nb</pre></td></tr></table>", "linenumber_table_code", "WARN", 1),
    ("<table><tr><td>x</td><td>y</td></tr></table>", "linenumber_table_code", "WARN", 0),
    ("<p>import java.util.List;<br>\nimport java.util.Map;</p>", "potential_code_block", "WARN", 1),
    ("<pre><code>a<br>b<br>c</code></pre>", "code_no_newlines", "WARN", 1),
    ("<pre>" + "int a = 1; int b = 2; " * 3 + "</pre>", "code_no_newlines", "WARN", 1),
]


def test_detectors(spark):
    made = spark.createDataFrame([(k, f"<article><p>Some text</p>{s[0]}</article>") for k, s in enumerate(SNIPPETS)], "slug int, html string")
    found = {(r["slug"], r["type"], r["level"]): r["n"] for r in detect.scan(dom_nodes(made)).groupBy("slug", "type", "level").count().withColumnRenamed("count", "n").collect()}
    for k, (_, kind, level, n) in enumerate(SNIPPETS):
        assert found.get((k, kind, level), 0) == n, SNIPPETS[k]


def test_scan_of_odd_pages(spark):
    made = spark.createDataFrame([("null", None), ("empty", ""), ("bare", "<article></article>"), ("text", "<article>words</article>"), ("byline", "<article><p>By Ann<img src='https://a.b/c'></p><p>x</p></article>")], "slug string, html string")
    found = {(r["slug"], r["type"]) for r in detect.scan(dom_nodes(made)).collect()}
    assert found == {("null", "no_article"), ("empty", "no_article"), ("bare", "no_article")}


def test_spacers_and_missing_files(spark):
    page = '<article><img src="/spacer.gif" width="5" height="9"><img src="/x.gif" height="1" alt=""><img src="../../assets/a.png" alt="a"><img src="../../assets/b.png" alt="b"></article>'
    nodes = dom_nodes(spark.createDataFrame([("p", page)], "slug string, html string"))
    assert [r["detail"] for r in detect.layout_spacers(nodes).collect()] == ["2 layout spacer image(s), the first 5x9"]
    files = spark.createDataFrame([("assets/a.png",)], "path string")
    assert [r["detail"] for r in detect.missing_local_image(nodes, files).collect()] == ["Image file is missing: assets/b.png"]


def test_selectors():
    root = dom.parse('<article><div><p>a</p><p>b</p></div><div id="x"><p>c</p></div></article>')
    assert [dom.selector(n) for n in root.all("p")] == ["div:nth-of-type(1) > p:nth-of-type(1)", "div:nth-of-type(1) > p:nth-of-type(2)", "div:nth-of-type(2) > p"]
    assert dom.selector(root.all("div")[1]) == "#x"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/apbdivtrl =\"'&;x \n", max_size=80))
def test_parse_never_fails_and_settles(markup):
    once = dom.parse(markup).inner()
    assert dom.parse(once).whole().split() == dom.parse(markup).whole().split()


def test_enrich_is_idempotent():
    page = '<article><pre class="brush: java; toolbar"><code>public class A {<br>}</code></pre><iframe src="https://www.youtube.com/embed/ab"></iframe><object data="x.swf"></object><script src="https://gist.github.com/u/12.js"></script></article>'
    once, stats = rewrite.enrich(page)
    assert rewrite.enrich(once)[0] == once
    assert (stats["youtube_replaced"], stats["gists_failed"], stats["embeds_replaced"], stats["pre_br_normalised"], stats["code_classes_normalised"]) == (1, 1, 1, 1, 1)
    assert "language-java" in once and "watch?v=ab" in once


def test_enrich_inlines_all_gist_files(spark):
    made = spark.createDataFrame([("a", '<article><script src="https://gist.github.com/u/12ab.js"></script></article>'), ("b", None)], "slug string, html string")
    gists = spark.createDataFrame([("12ab", [("x.py", "Python", "print(1)"), ("y.sh", None, "ls")])], "gist_id string, files array<struct<name:string,language:string,content:string>>")
    rows = {r["slug"]: r for r in pages.enrich(made, gists).collect()}
    assert rows["a"]["gists_replaced"] == 1 and "language-python" in rows["a"]["html"] and "language-text" in rows["a"]["html"]
    assert rows["b"]["html"] is None


def test_code_repair():
    assert rewrite.reformat_drl('rule "a when b" when A() then insert(x); end') == 'rule "a when b"\nwhen\nA()\nthen\ninsert(x);\nend'
    assert rewrite.reformat_xml("<a><b>1</b></a>") == "<a>\n  <b>1</b>\n</a>"
    assert rewrite.reformat_xml("<a><b></a>") == "<a><b></a>"
    root = dom.parse("<article><section><p>rule \"x\"<br>when<br>A()<br>then<br>b();<br>end</p></section><table><tr><td><div>1</div><div>2</div></td><td><code class='language-java'><div>int a;</div><div>int b;</div></code></td></tr></table></article>")
    assert rewrite.fix_code(root)
    assert [p.whole() for p in root.all("pre")][1] == "int a;\nint b;"


def test_metadata_and_extraction(spark):
    ld = '<script type="application/ld+json">{"@type":"BlogPosting","headline":"H","author":{"name":"Ann"},"datePublished":"2020-02-03T00:00:00Z","keywords":["k1","k2"]}</script>'
    page = f'<html><head>{ld}<title>T - Site</title></head><body><nav>menu</nav><div class="entry-content"><p onclick="x()">Hi <a href="javascript:x">l</a></p><img src="a.png"><div class="sidebar">s</div></div></body></html>'
    fetched = spark.createDataFrame([("https://a.b/2020/hello-World", 200, page, None), ("https://a.b/x", 404, "", None), ("https://a.b/y", None, None, "Fetch error: t"), ("https://a.b/z", 200, "", None)], "url string, status int, body string, error string")
    rows = {r["url"][-1]: r for r in pages.extract_posts(fetched).collect()}
    ok = rows["d"]
    assert (ok["title"], ok["author"], ok["date"], list(ok["categories"]), ok["asset_count"], ok["error"], ok["slug"]) == ("H", "Ann", "2020-02-03", ["k1", "k2"], 1, "", "2020-02-03-hello-world")
    assert "onclick" not in ok["html"] and "javascript" not in ok["html"] and "sidebar" not in ok["html"]
    assert rows["x"]["error"] == "HTTP 404" and rows["y"]["error"] == "Fetch error: t" and rows["z"]["error"] == "No article found"


def test_conversion(spark):
    body = "<h2>Head <a href='x'>link</a></h2><p>A <b>bold</b> and <i>it</i> <a href='http://u/v'>l</a></p><ul><li>one</li><li>two</li></ul><pre><code class='language-java'>a ``` b</code></pre><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table><p></p><h3>Related Posts</h3><p>gone</p>"
    rows = [("a", f"<article>{body}</article>", "A \"title\"", "2020-01-02T00", "Ann", ["c"], [], "http://o"), ("n", None, "t", "", "", None, None, None)]
    made = spark.createDataFrame(rows, "slug string, html string, title string, date string, author string, categories array<string>, tags array<string>, original_url string")
    got = {r["slug"]: r["md"] for r in pages.convert(made).collect()}
    assert got["n"] is None
    head, text = got["a"].split("\n---\n\n", 1)
    assert 'title: "A \\"title\\""' in head and "date: 2020-01-02" in head and "categories: \n  - c" in head and "tags: []" in head
    assert text == "## Head link\n\nA **bold** and *it* [l](http://u/v)\n\n* one\n* two\n\n````java\na ``` b\n````\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n"


@pytest.mark.parametrize("text, language", [("import java.util.List;", "java"), ("<?xml version", "xml"), ("SELECT a FROM b", "sql"), ("def f(x):", "python"), ("nothing", None)])
def test_language_detection(text, language):
    assert rewrite.detect_language(text) == language
