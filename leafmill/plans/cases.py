"""Queries that run one operator over made forms of every document, with what it must return stated form by form.

Each query takes the documents, gives each the form that its id chooses, with the id in it wherever the form says {id},
and runs the operator over all of them; the SQL states the result of each form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import markdown, rewrite, urls
from leafmill.operators import consolidate, detect, pages, posts, refine, state, validate
from leafmill.operators.nodes import dom_nodes
from leafmill.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
Made = Callable[[DataFrame], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sql(text: str | None) -> str:
    if text is None:
        return "NULL"
    quoted = text.replace("'", "''").replace("\n", "'||chr(10)||'")
    return f"replace('{quoted}', '{{id}}', doc_id::VARCHAR)"


def forms(spark: SparkSession, sf_dir: str, given: Sequence[tuple]) -> DataFrame:
    """(doc_id, given...) of every document: the columns a, b, ... of the form that its id chooses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    which = (F.col("doc_id") % len(given)).cast("int")
    columns = []
    for k in range(len(given[0])):
        texts = F.array(*[F.lit(row[k]).cast("string") for row in given])
        columns.append(F.replace(F.get(texts, which), F.lit("{id}"), F.col("doc_id").cast("string")).alias("abcdef"[k]))
    return docs.select("doc_id", *columns)


def case(name: str, given: Sequence, want: Sequence[str | None], value: str = "value"):
    """Register a query whose function maps forms(doc_id, a, b, ...) to (doc_id, value)."""
    rows = [g if isinstance(g, tuple) else (g,) for g in given]
    assert len(rows) == len(want), name

    def add(f: Made) -> Made:
        QUERIES[name] = lambda spark, sf_dir: f(forms(spark, sf_dir, rows)).select("doc_id", F.col("value").alias(value))
        arms = " ".join(f"WHEN {k} THEN {_sql(w)}" for k, w in enumerate(want))
        ORACLES[name] = f"SELECT doc_id, CASE doc_id % {len(rows)} {arms} END AS {value} FROM documents"
        return f

    return add


def shown(*columns: Column | str) -> Column:
    """Columns as one text, nulls as ~."""
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in columns])


def listed(rows: DataFrame, docs: DataFrame, *columns: Column | str) -> DataFrame:
    """(doc_id, value): the rows of each document as one text, in the order of their texts; empty without rows."""
    texts = rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(shown(*columns))), "; ").alias("value"))
    return docs.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("value", F.lit("")).alias("value"))


# ---- addresses and names


@case("url_dates", ["2020-01-1{id}", " 2019-05-06T10:00:00Z ", "May {id}", None], ["2020-01-1{id}", "2019-05-06", "May {id}", ""])
def url_dates(f):
    day = F.col("a").rlike(r"^2020-01-1\d{2,}$")
    return f.select("doc_id", F.when(day, F.col("a")).otherwise(urls.iso_date(F.col("a"))).alias("value"))


@case("url_video_ids", ["https://www.youtube.com/watch?v=v{id}&t=3", "https://youtu.be/s{id}?x=1", "https://www.youtube.com/embed/e{id}", "https://example.com/watch?v=n{id}", None], ["v{id}", "s{id}", "e{id}", None, None])
def url_video_ids(f):
    return f.select("doc_id", urls.youtube_id(F.col("a")).alias("value"))


@case("url_gist_ids", ["https://gist.github.com/someone/a{id}.js", "https://gist.github.com/b{id}", "https://github.com/someone/c{id}", "https://gist.github.com/"], ["a{id}", "b{id}", None, None])
def url_gist_ids(f):
    return f.select("doc_id", urls.gist_id(F.col("a")).alias("value"))


@case("url_safe_names", ["https://e.com/a b({id}).png?x=1", "https://e.com/", "https://e.com/x/ü{id}.gif", None], ["a_b_{id}_.png", "asset", "_{id}.gif", "asset"])
def url_safe_names(f):
    return f.select("doc_id", urls.safe_filename(F.col("a")).alias("value"))


@case("url_short_slugs", [("https://e.com/2020/My_Post-{id}.html", "2020-02-03"), ("https://e.com/p{id}.htm", None), ("https://e.com/a--b!{id}", "2021-01-01T00:00:00")], ["2020-02-03-my-post-{id}", "undated-p{id}", "2021-01-01-a-b-{id}"])
def url_short_slugs(f):
    return f.select("doc_id", urls.slug(F.col("a"), F.col("b"), True).alias("value"))


@case("project_ids", ["My Project {id}", "  --A{id}!!", "Ünder {id} & over"], ["my-project-{id}", "a{id}", "nder-{id}-over"])
def project_ids(f):
    return f.select("doc_id", urls.project_id(F.col("a")).alias("value"))


@case("stored_paths", [("/root/p/{id}", "/root"), ("/root", "/root"), ("/other/{id}", "/root"), ("/root/x{id}", None)], ["p/{id}", ".", "/other/{id}", "/root/x{id}"])
def stored_paths(f):
    return f.select("doc_id", urls.stored_path(F.col("a"), F.col("b")).alias("value"))


@case("path_traversal", ["a/{id}.png", "../{id}", "a/%2e%2e/{id}", "a\\..\\{id}", "a..b/{id}"], ["false", "true", "true", "true", "false"])
def path_traversal(f):
    return f.select("doc_id", urls.traversal(F.col("a")).cast("string").alias("value"))


@case("asset_places", [("https://e.com/i/x{id}.png", "2020-03-04"), ("https://e.com/", "")], ["/assets/images/2020/03|-x{id}.png", "/assets/images/undated|-asset"])
def asset_places(f):
    place = urls.asset_path(F.col("a"), F.col("b"))
    return f.select("doc_id", F.concat_ws("|", F.regexp_extract(place, "^(.*)/[^/]*$", 1), F.regexp_extract(place, "/[0-9a-f]{12}(-[^/]*)$", 1)).alias("value"))


# ---- discovery


def _found(read: Callable[[DataFrame], DataFrame]) -> Made:
    def run(f: DataFrame) -> DataFrame:
        rows = read(f.select(F.col("doc_id").alias("site"), F.col("a").alias("body"))).withColumnRenamed("site", "doc_id")
        return listed(rows, f, F.lpad(F.col("pos").cast("string"), 2, "0"), "url")

    return run


case("sitemap_posts", ["<urlset><url><loc>https://e.com/2020/p{id}</loc></url><url><loc> https://e.com/tag/x </loc></url><url><loc>https://e.com/q?a=1&amp;b={id}</loc></url></urlset>", "<html>none</html>", None],
     ["00|https://e.com/2020/p{id}; 02|https://e.com/q?a=1&b={id}", "", ""])(_found(feeds.sitemap_urls))
case("sitemap_children", ["<sitemapindex><sitemap><loc>https://e.com/page-sitemap.xml</loc></sitemap><sitemap><loc>https://e.com/post-sitemap{id}.xml</loc></sitemap></sitemapindex>", "<sitemapindex><sitemap><loc>https://e.com/a{id}.xml</loc></sitemap></sitemapindex>", "<urlset/>"],
     ["01|https://e.com/post-sitemap{id}.xml", "00|https://e.com/a{id}.xml", ""])(_found(feeds.sitemap_index))
case("feed_posts", ["<rss><channel><link>https://e.com</link><item><title>a</title><link>https://e.com/r{id}</link></item><item><link><![CDATA[https://e.com/c{id}]]></link></item></channel></rss>", "<feed><entry><link rel='self' href='https://e.com/self'/><link rel='alternate' href='https://e.com/a{id}'/></entry></feed>", "no feed"],
     ["00|https://e.com/r{id}; 01|https://e.com/c{id}", "00|https://e.com/a{id}", ""])(_found(feeds.feed_links))
case("rest_posts", ['[{"link":"https://e.com/w{id}"},{"id":1},{"link":"https://e.com/x{id}"}]', '{"code":"none"}', "<html>"], ["00|https://e.com/w{id}; 01|https://e.com/x{id}", "", ""])(_found(feeds.rest_links))


@case("platforms", [("https://a{id}.com", "200", '{"name":"Blog {id}"}', "<title>T</title>"), ("https://b{id}.blogspot.com", "404", "", "<title> My blog </title>"), ("https://c{id}.com", "404", "no", '<meta name="generator" content="Ghost 4"><meta property="og:site_name" content="C{id}">'), ("https://d{id}.com", "200", "<html>", "")],
     ["wordpress|Blog {id}", "blogger|My blog", "ghost|C{id}", "generic|d{id}.com"])
def platforms(f):
    probes = f.select("doc_id", F.col("a").alias("site"), F.col("b").cast("int").alias("rest_status"), F.col("c").alias("rest_body"), F.col("d").alias("page_body"))
    found = feeds.platform(probes.drop("doc_id")).dropDuplicates(["site"])
    return probes.join(found, "site").select("doc_id", shown("platform", "name").alias("value"))


# ---- extraction and enrichment


_META = '<html><head><title>T{id} - Site</title><meta property="og:title" content="Og {id}"><meta property="article:published_time" content="2020-01-15T08:00:00Z"><meta name="author" content="Ann"><meta property="og:site_name" content="Site {id}"></head><body><nav>menu</nav><article class="post"><h1>H</h1><p>Text {id}</p><img src="https://e.com/{id}.png"><img src="data:x"><script>x()</script></article></body></html>'
_LD = '<script type="application/ld+json">{"@type":"BlogPosting","headline":"Ld {id}","datePublished":"2019-02-03","author":{"name":"Bob"}}</script><div class="entry-content"><p>Body {id}</p></div>'


@case("post_extraction", [("https://e.com/p{id}", "200", _META, None), ("https://e.com/q{id}", "200", _LD, None), ("https://e.com/r{id}", "404", "gone", None), ("https://e.com/s{id}", None, None, "Fetch error: timed out"), ("https://e.com/t{id}", "200", "", None)],
     ["Og {id}|2020-01-15|Ann|Site {id}|2020-01-15-p{id}|1||true", "Ld {id}|2019-02-03|Bob||2019-02-03-q{id}|0||true", "|||||0|HTTP 404|false", "|||||0|Fetch error: timed out|false", "|||||0|No article found|false"])
def post_extraction(f):
    fetched = f.select(F.col("a").alias("url"), F.col("b").cast("int").alias("status"), F.col("c").alias("body"), F.col("d").alias("error"))
    found = pages.extract_posts(fetched)
    whole = found["html"].contains("<p>") & ~found["html"].contains("<script")
    slug = F.when(found["date"] != "", found["slug"]).otherwise("")
    texts = found.select("url", shown("title", "date", "author", "site", slug, "asset_count", "error", whole).alias("value"))
    return f.join(texts, F.col("a") == texts["url"]).select("doc_id", "value")


_COUNTS = ("pre_br_normalised", "code_classes_normalised", "youtube_replaced", "gists_replaced", "gists_failed", "languages_detected", "embeds_replaced")


@case("enrichment", [
    '<article><iframe src="https://www.youtube.com/embed/y{id}"></iframe></article>', '<article><script src="https://gist.github.com/u/known.js"></script></article>', '<article><script src="https://gist.github.com/u/lost{id}.js"></script></article>',
    '<article><pre class="brush: java; gutter: false">int x{id};</pre></article>', "<article><pre>a{id}<br>b<br/>c</pre></article>", "<article><pre><code>SELECT a FROM t{id}</code></pre></article>", '<article><embed src="https://e.com/{id}.swf"></article>', "<article><p>plain {id}</p></article>"],
    ["0|0|1|0|0|0|0|watch?v=y{id}", "0|0|0|1|0|0|0|language-java", "0|0|0|0|1|0|0|archive-note", "0|1|0|0|0|0|0|language-java", "1|0|0|0|0|0|0|a{id}~b~c", "0|0|0|0|0|1|0|language-sql", "0|0|0|0|0|0|1|archive-note", "0|0|0|0|0|0|0|plain {id}"])
def enrichment(f):
    gists = f.sparkSession.range(1).select(F.lit("known").alias("gist_id"), F.array(F.struct(F.lit("A.java").alias("name"), F.lit("Java").alias("language"), F.lit("class A {}").alias("content"))).alias("files"))
    done = pages.enrich(f.select("doc_id", "a"), gists, "doc_id", "a")
    sign = F.regexp_extract(F.translate("html", "\n", "~"), r"(watch\?v=\w+|language-\w+|a\d+~b~c|archive-note|plain \d+)", 1)
    return done.select("doc_id", shown(*_COUNTS, sign).alias("value"))


@case("code_repair", [
    "<article><table><tr><td><pre>1\n2</pre></td><td><pre><code>int a{id};\nint b;</code></pre></td></tr></table></article>",
    '<article><p>rule "r{id}"<br>when<br>x<br>then<br>y<br>end</p></article>', "<article><p>Just a line<br>and one more {id}</p></article>"],
    ["int a{id};~int b;", 'rule "r{id}"', ""])
def code_repair(f):
    done = pages.enrich(f.select("doc_id", "a"), None, "doc_id", "a")
    return done.select("doc_id", F.regexp_extract(F.translate("html", "\n", "~"), r'<pre[^>]*><code[^>]*>(int a\d+;~int b;|rule "r\d+")', 1).alias("value"))


_ROW = {"title": "T", "date": "2020-01-01", "author": "A", "original_url": "https://e.com"}


@case("conversion", [
    "<article><h2>Head {id}</h2><p>One <b>bold</b>, <i>thin</i> and <code>x</code>.</p></article>", "<article><ul><li>a{id}</li><li>b</li></ul><ol><li>c</li><li>d</li></ol></article>",
    '<article><p><a href="https://e.com/{id}">link</a> <img src="https://e.com/{id}.png" alt="pic"></p></article>', '<article><pre><code class="language-java">int x{id};</code></pre></article>',
    "<article><table><tr><th>h</th><th>i</th></tr><tr><td>{id}</td><td>2</td></tr></table></article>", "<article><blockquote><p>Said {id}</p><p>and more</p></blockquote></article>", '<article><div class="sharedaddy">Share</div><p>Kept {id}</p><script>x</script></article>',
    '<article><p>Text {id}</p><h2>Related posts</h2><ul><li>x</li></ul></article>', "<article><pre>a ``` b{id}</pre></article>", "<p>none</p>"],
    ["## Head {id}~~One **bold**, *thin* and `x`.", "* a{id}~* b~~1. c~2. d", "[link](https://e.com/{id}) ![pic](https://e.com/{id}.png)", "```java~int x{id};~```", "| h | i |~| --- | --- |~| {id} | 2 |", "Said {id}~~and more", "Kept {id}", "Text {id}", "````~a ``` b{id}~````", "none"])
def conversion(f):
    empty = F.array().cast("array<string>")
    posts_ = f.select("doc_id", "a", *[F.lit(v).alias(k) for k, v in _ROW.items()], empty.alias("categories"), empty.alias("tags"))
    md = pages.convert(posts_, "doc_id", "a").select("doc_id", markdown.body(F.col("md")).alias("body"))
    return md.select("doc_id", F.translate(F.regexp_replace("body", r"\A\s+|\s+\z", ""), "\n", "~").alias("value"))


@case("front_matter", [('Say "{id}"', "2020-01-01", "A"), ("Plain {id}", "", "B: b")], ['Say \\"{id}\\"|2020-01-01|true', "Plain {id}||true"])
def front_matter(f):
    empty = F.array().cast("array<string>")
    made = f.select("doc_id", F.lit("<article><p>x</p></article>").alias("html"), F.col("a").alias("title"), F.col("b").alias("date"), F.col("c").alias("author"), empty.alias("categories"), empty.alias("tags"), F.lit("https://e.com").alias("original_url"))
    head = markdown.front_matter(F.col("md"))
    got = lambda k: F.regexp_extract(head, rf'(?m)^{k}:[ ]*"?(.*?)"?$', 1)
    return pages.convert(made, "doc_id").select("doc_id", shown(got("title"), got("date"), head.contains("original_url")).alias("value"))


# ---- defects


_DEFECTS = [
    ('<article><img src="data:x" alt="a{id}"></article>', 'data_placeholder|ERROR|Image is a lazy-load placeholder, alt="a{id}"|img'),
    ('<article><p>a</p><noscript><img src="https://e.com/{id}.png"></noscript></article>', "external_image|WARN|Image is not local: https://e.com/{id}.png|noscript > img; noscript_remnant|WARN|Image address in noscript: https://e.com/{id}.png|noscript"),
    ('<article><iframe title="t{id}"></iframe></article>', 'empty_embed|ERROR|iframe without a source, title="t{id}"|iframe'),
    ('<article><iframe data-src="https://e.com/{id}"></iframe></article>', "empty_embed|WARN|iframe has only data-src: https://e.com/{id}|iframe"),
    ('<article><script src="https://gist.github.com/u/{id}.js"></script></article>', "unreplaced_gist|ERROR|Gist is not inlined: https://gist.github.com/u/{id}.js|script"),
    ('<article><img src="https://pixel.wp.com/{id}.gif" width="1" height="1"></article>', "tracking_pixel|WARN|Tracking pixel from pixel.wp.com: https://pixel.wp.com/{id}.gif|img"),
    ('<article><img src="https://e.com/{id}.png"></article>', "external_image|WARN|Image is not local: https://e.com/{id}.png|img"),
    ('<article><div class="entry-meta">Meta {id}</div></article>', 'wordpress_chrome|WARN|Page chrome (.entry-meta): "Meta {id}"|div'),
    ('<article><p>Leave a Reply {id}</p></article>', 'wordpress_chrome|WARN|Metadata in the article: "Leave a Reply {id}"|p'),
    ("<article><p>As shown below {id}</p><p>no picture</p></article>", 'missing_image_signal|WARN|Text announces an image: "As shown below {id}"|p:nth-of-type(1)'),
    ("<article><p><b>x{id}</b>tail</p></article>", 'md_notation_in_text|WARN|<b> "x{id}" runs into "t"|p > b'),
    ("<article><pre><code>a{id}\n&lt;table&gt;</code></pre></article>", "suspicious_code_content|WARN|Code block holds escaped markup; dismiss if it is meant|pre"),
    ('<article><a href="https://imgur.com/{id}">x</a></article>', "imgur_image|WARN|imgur address, use an archived one: https://imgur.com/{id}|a"),
    ("<article><table><tr><td><pre>1\n2</pre></td><td><pre>int a{id};\nint b;</pre></td></tr></table></article>", 'linenumber_table_code|WARN|Line-number table of code: "int a{id};\nint b;"|table'),
    ('<article><p>public class A{id} {<br>\nint x;<br>\n}</p></article>', 'potential_code_block|WARN|Text with line breaks looks like code: "public class A{id} { int x; }"|p'),
    ("<article><pre>a{id}<br>b<br>c</pre></article>", "code_no_newlines|WARN|Code block uses br for line ends|pre"),
    ("<article></article>", "no_article|ERROR|Page has no article or body, or an empty one|article"),
    ('<article><img src="spacer.gif" width="3" height="{id}"><img src="spacer.gif"></article>', "layout_spacer_image|WARN|2 layout spacer image(s), the first 3x{id}|img:nth-of-type(1)"),
    ('<article><img src="../../assets/{id}.png"></article>', "missing_local_image|ERROR|Image file is missing: assets/{id}.png|img"),
    ("<article><p>Nothing wrong with {id}.</p></article>", ""),
    ("<article><p>By Ann {id}</p><p>Text.</p></article>", ""),
]


@case("defects", [d for d, _ in _DEFECTS], [w for _, w in _DEFECTS])
def defects(f):
    """Every kind of issue, with its level, words and place."""
    files = f.sparkSession.range(0).select(F.lit("x").alias("path"))
    return listed(detect.scan_all(dom_nodes(f.select("doc_id", "a"), "doc_id", "a"), files), f, "type", "level", "detail", "selector")


@case("scan_totals", ['<article><img src="data:x"><img src="data:y"></article>', "<article><p>{id}</p></article>"], ["data_placeholder|2", ""])
def scan_totals(f):
    """The summary of each page's issues by type, through the summary of one page's issues at a time."""
    found = detect.scan_all(dom_nodes(f.select("doc_id", "a"), "doc_id", "a"))
    return listed(found.groupBy("doc_id", "type").agg(F.count("*").alias("n")), f, "type", "n")


# ---- Markdown and its checks


def _md(body: str, head: str = "---\ntitle: T\ndate: 2020-01-01\nauthor: A\n---\n") -> str:
    return head + body


_LONG = "This body has enough characters to be one, {id}.\n"
_CHECKS = [
    (_md(_LONG), ""), (_md(_LONG + "@@CODEBLOCK_001@@"), "orphaned_placeholder|ERROR|Placeholders are left: @@CODEBLOCK_001@@"), (_md(_LONG + "```java\nx\n```\ntext\n```3\ny\n```\n"), "code_fence_language|WARN|Unknown languages: 3; stray_digit_after_fence|ERROR|A digit follows a fence"),
    (_md(_LONG + "```java\nx\n"), "unbalanced_fences|ERROR|A code fence stays open"), (_md(_LONG + "```java\n```\n"), "empty_code_block|WARN|A code block is empty"),
    (_LONG, "front_matter_invalid|ERROR|No front matter"), ("---\ntitle: T\n" + _LONG, "front_matter_invalid|ERROR|Front matter is not closed"), (_md(_LONG, "---\ntitle: T\n---\n"), "front_matter_invalid|ERROR|Fields are missing: date, author"),
    (_md(_LONG, "---\ntitle: T\ndate: May\nauthor: A\n---\n"), "front_matter_invalid|WARN|The date is not YYYY-MM-DD"), (_md("short"), "empty_body|ERROR|The body has 5 characters"), (_md(_LONG + "Post Comment"), "wordpress_junk|WARN|Chrome of the blog is left"),
    (_md(_LONG + "&amp;&lt;&gt;&quot;&nbsp;"), "html_entities_in_body|WARN|5 HTML entities in the body"), (_md(_LONG + "../../assets/x"), "local_image_paths|ERROR|A relative asset path is left"), (_md(_LONG + "[x]()"), "broken_md_links|WARN|A link has no address"),
    (_md(_LONG + "a\n\n\n\nb"), "no_triple_blanks|WARN|Three blank lines or more"), (_md(_LONG + "x" * 8001), "excessive_line_length|WARN|A line has 8001 characters"), (_md(_LONG + "MISSING_IMAGE " * 11), "many_missing_images|WARN|11 images are missing"),
    (_md(_LONG + "```zork\nx\n```"), "code_fence_language|WARN|Unknown languages: zork"),
]


@case("text_checks", [d for d, _ in _CHECKS], [w for _, w in _CHECKS])
def text_checks(f):
    """Every check of a text by itself, with its level and words."""
    return listed(validate.check(f.select("doc_id", "a"), "doc_id", "a"), f, "check", "level", "detail")


_P = "A first paragraph of the post that has quite a few words in it, so that it counts as one of its phrases {id}."
_PLAIN = f"<p>{_P}</p>"
_CROSS = [
    (_PLAIN, _P, ""), ("<p>" + "word " * 200 + "</p>", "word " * 200 + "x", ""), ("<p>" + "word " * 200 + "end</p>", "few word", "last_section_present; word_count"),
    (_PLAIN + "<pre>code{id} is here now</pre>", _P, "code_block_count; code_content_missing"), (_PLAIN + "<h2>Heading one</h2>", _P, "heading_match"), (_PLAIN + "<ul><li>a</li><li>b</li></ul>", _P + "\n\na b", "lists_dropped"),
    (_PLAIN + "<table><tr><td>one two three four</td></tr><tr><td>five six seven</td></tr></table>", _P, "table_dropped"), (_PLAIN + '<img src="a"><img src="b"><img src="c"><img src="d">', _P, "images_dropped"),
    (_PLAIN + "<blockquote>A quote that is long enough to count</blockquote>", _P, "blockquotes_dropped"), (_PLAIN, _P + "\n\nLeave a reply", "chrome_leakage"), (_PLAIN + '<a href="https://www.youtube.com/watch?v=1">v</a>', _P, "youtube_count"),
    (_PLAIN, _P + "\n\n" + _P, "duplicate_paragraph"), (_PLAIN + "".join(f'<a href="https://e.com/{k}">l</a>' for k in range(7)), _P, "links_dropped"), (_PLAIN + '<pre><code class="language-java">int x = {id};</code></pre>', _P + "\n\n```\nint x = {id};\n```", "html_languages_missing"),
    (_PLAIN, "Nothing of it.", "content_phrase_missing; last_section_present"),
]


@case("cross_checks", [(f"<article>{h}</article>", _md(m)) for h, m, _ in _CROSS], [w for _, _, w in _CROSS])
def cross_checks(f):
    """Every check of a text against its page."""
    return listed(validate.cross_check(f.select("doc_id", F.col("b").alias("md")), f.select("doc_id", F.col("a").alias("html")), "doc_id"), f, "check")


@case("text_cleaning", ["Head {id}\n====\ntext", "Sub {id}\n---\ntext", "a{id}\n\n\n\nb", "x [](https://e.com/{id}) y", "```\nh{id}\n====\n\n\n\nz\n```", "| a |\n\n| {id} |", "## Author\nk{id}"],
     ["# Head {id}~text", "## Sub {id}~text", "a{id}~~b", "x  y", "```~h{id}~====~~~~z~```", "| a |~| {id} |", "k{id}"])
def text_cleaning(f):
    return f.select("doc_id", F.translate(markdown.clean(F.col("a")), "\n", "~").alias("value"))


@case("similarity", [("abcd", "abcf"), ("", ""), ("abc", ""), ("ab{id}", "ab{id}")], ["0.75", "1.0", "0.0", "1.0"])
def similarity(f):
    return f.select("doc_id", markdown.similarity(F.col("a"), F.col("b")).cast("string").alias("value"))


@case("archive_headers", ['<header class="archive-header x">from {id}</header><p>a</p>', "<header>b {id}</header>"], ["<p>a</p>", "<header>b {id}</header>"])
def archive_headers(f):
    return f.select("doc_id", pages.without_archive_header(F.col("a")).alias("value"))


# ---- refinement


@case("fence_suggestions", ["```\nx{id}\n```", "```java\nThis is a line of prose in code.\nAnd here is another long line of it.\nx{id}\n```", "```java\ny{id}\n```"], ["language_tag_missing|0", "prose_in_code|0", ""])
def fence_suggestions(f):
    found = refine.suggest(pages.fences(f.select("doc_id", "a"), "doc_id", "a"))
    return listed(found.withColumn("again", refine.fence_index(F.col("detail"))).filter("again = fence_index"), f, "check", "fence_index")


_SIGNS = [("import java.x{id};", "java"), ("<beans>{id}", "xml"), ("insert into t{id}", "sql"), ("print({id})", "python"), ("import os: {id}", "python"), ("const a = {id}", "javascript"), ("x => {id}", "javascript"), ("echo {id}", "bash"), ("rule {id} when a then b", "drl"), ("nothing {id}", "text")]


@case("fence_languages", [s for s, _ in _SIGNS], [w for _, w in _SIGNS])
def fence_languages(f):
    return f.select("doc_id", refine.infer_language(F.col("a")).alias("value"))


@case("rule_replay", ["a{id}\n\n```\nint x = {id}; import java.y;\n```\n", "```java\nThis is a line of prose in code.\nAnd here is another long line of it.\nx{id}\n```\n", "plain {id}"],
      ["a{id}~~```java~int x = {id}; import java.y;~```~", "This is a line of prose in code.~And here is another long line of it.~~```java~x{id}~```~", "plain {id}"])
def rule_replay(f):
    """Suggestions turned to rules and replayed on their own texts, as after a new conversion."""
    texts = f.select("doc_id", F.col("a").alias("md"))
    fences = pages.fences(texts, "doc_id")
    return refine.replay(texts, refine.build_rules(refine.suggest(fences), fences), "doc_id").select("doc_id", F.translate("md", "\n", "~").alias("value"))


@case("lost_rules", ["```java\nx{id}\n```\n"], ["language_tag_missing@fence_7"])
def lost_rules(f):
    """Rules whose fence is gone are conflicts."""
    texts = f.select("doc_id", F.col("a").alias("md"))
    rules = f.select("doc_id", F.lit("language_tag_missing").alias("check"), F.lit(7).alias("fence_index"), F.lit("f").alias("fingerprint"), F.lit("s").alias("content_sample"), F.create_map(F.lit("language"), F.lit("java")).alias("fix"))
    return refine.replay(texts, rules, "doc_id").select("doc_id", F.array_join("conflicts", ",").alias("value"))


# ---- state


def _state(f: DataFrame) -> DataFrame:
    kind = f.sparkSession.createDataFrame([], state.SCHEMA).schema
    made = f.select(F.col("doc_id").cast("string").alias("slug"), F.struct(F.lit("t").alias("title")).alias("x"))
    return made.select("slug", *[F.lit(None).cast(k.dataType).alias(k.name) for k in kind if k.name != "slug"])


def _of(done: DataFrame, *columns: Column | str) -> DataFrame:
    return done.select(F.col("slug").cast("long").alias("doc_id"), shown(*columns).alias("value"))


def _now() -> Column:
    return F.lit("2020-01-01 00:00:00").cast("timestamp")


@case("state_md_issues", ["{id}", ""], ["1|c|i{id}|true", "0|~|~|true"])
def state_md_issues(f):
    found = f.filter("a <> ''").select(F.col("doc_id").cast("string").alias("slug"), F.lit("c").alias("check"), F.lit("WARN").alias("level"), F.concat(F.lit("i"), "a").alias("detail"))
    done = state.set_md_issues(_state(f), found, f.select(F.col("doc_id").cast("string").alias("slug")), _now())
    return _of(done, F.size("md.issues"), F.get("md.issues", F.lit(0))["check"], F.get("md.issues", F.lit(0))["detail"], F.col("md.validated_at") == _now())


@case("state_suggestions", ["{id}", ""], ["1|3|true", "0|~|true"])
def state_suggestions(f):
    found = f.filter("a <> ''").select(F.col("doc_id").cast("string").alias("slug"), F.lit("c").alias("check"), F.lit("WARN").alias("level"), F.lit("d").alias("detail"), F.lit(3).alias("fence_index"))
    done = state.set_md_suggestions(_state(f), found, f.select(F.col("doc_id").cast("string").alias("slug")), _now())
    return _of(done, F.size("md.suggestions"), F.get("md.suggestions", F.lit(0))["fence_index"], F.col("md.suggestions_at") == _now())


@case("state_refinement", ["keep", "clear"], ["1|p{id}|true", "0|~|~"])
def state_refinement(f):
    rules = f.select(F.col("doc_id").cast("string").alias("slug"), F.lit("c").alias("check"), F.lit(1).alias("fence_index"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("fingerprint"), F.lit("s").alias("content_sample"), F.create_map(F.lit("k"), F.lit("v")).alias("fix"))
    done = state.clear_refinement(state.set_refinement(_state(f), rules, _now()), f.filter("a = 'clear'").select(F.col("doc_id").cast("string").alias("slug")))
    return _of(done, F.size("refinement.accepted"), F.get("refinement.accepted", F.lit(0))["fingerprint"], F.col("refinement.refined_at") == _now())


@case("state_generated", ["<p>{id}</p>", None], ["true|false|~|0", "~|true|true|~"])
def state_generated(f):
    slugs = f.select(F.col("doc_id").cast("string").alias("slug"), "a")
    before = state.merge(_state(f), slugs.select("slug", F.struct(F.lit(True).alias("staged"), _now().alias("staged_at")).alias("md")))
    done = state.mark_generated(before, slugs.filter("a IS NOT NULL").select("slug", F.col("a").alias("html")), _now())
    return _of(done, F.col("md.html_hash") == F.col("html.hash"), "md.staged", F.col("md.staged_at") == _now(), F.when(F.col("md.issues").isNotNull(), F.size("md.issues")))


@case("state_enriched", ["<article><iframe src='https://youtu.be/{id}'></iframe></article>", "<article><p>{id}</p></article>"], ["1|0|true", "0|0|true"])
def state_enriched(f):
    done = pages.enrich(f.select(F.col("doc_id").cast("string").alias("slug"), F.col("a").alias("html")))
    return _of(state.mark_enriched(_state(f), done, _now()), "enriched.youtube_replaced", "enriched.gists_failed", F.col("enriched.generated_at") == _now())


@case("state_patch", [("true", "note {id}"), (None, None)], ["true|note {id}|kept", "~|~|kept"])
def state_patch(f):
    own = state.merge(_state(f), f.select(F.col("doc_id").cast("string").alias("slug"), F.lit("kept").alias("title")))
    changes = f.select(F.col("doc_id").cast("string").alias("slug"), F.col("a").cast("boolean").alias("reviewed"), F.col("b").alias("user_note"), F.lit("not allowed").alias("title"))
    return _of(state.patch(own, changes), "reviewed", "user_note", "title")


@case("state_dismissals", ["again", "new", "undone"], ["2020-01-01", "2021-01-01", "~"])
def state_dismissals(f):
    slugs = f.select(F.col("doc_id").cast("string").alias("slug"), "a")
    old = slugs.filter("a = 'again'").select("slug", F.lit("t").alias("type"), F.lit("2020-01-01").alias("ts"))
    both = state.dismiss(old, slugs.select("slug", F.lit("t").alias("type"), F.lit("2021-01-01").alias("ts")), slugs)
    left = state.undismiss(both, slugs.filter("a = 'undone'").select("slug", F.lit("t").alias("type")))
    return _of(slugs.join(left, "slug", "left"), "ts")


@case("text_edits", ["new {id}", None], ["new {id}", "old"])
def text_edits(f):
    slugs = f.select(F.col("doc_id").cast("string").alias("slug"), "a")
    return _of(state.save_md(slugs.select("slug", F.lit("old").alias("md")), slugs.filter("a IS NOT NULL").select("slug", F.col("a").alias("md"))), "md")


@case("page_edits", ["new {id}", None], ["new {id}", "old"])
def page_edits(f):
    slugs = f.select(F.col("doc_id").cast("string").alias("slug"), "a")
    return _of(state.save_html(slugs.select("slug", F.lit("old").alias("html")), slugs.filter("a IS NOT NULL").select("slug", F.col("a").alias("html"))), "html")


@case("rejected_versions", ["reject", "wait"], ["1", "2"])
def rejected_versions(f):
    slugs = f.select(F.col("doc_id").cast("string").alias("slug"), "a")
    staged = state.stage(slugs.select("slug", F.lit(1).alias("version"), F.lit("live").alias("status"), F.lit("m").alias("md")), slugs.select("slug", F.lit("n").alias("md")))
    return _of(state.reject(staged, slugs.filter("a = 'reject'")).groupBy("slug").agg(F.max("version").alias("top")), "top")


# ---- assets


@case("asset_localisation", [("https://e.com/{id}.png", "direct"), ("https://imgur.com/{id}.png", "both"), ("https://e.com/x{id}.png", "archive"), ("https://e.com/y{id}.png", "none")],
     ['<img src="a/{id}.png">|direct', '<img src="old/{id}.png">|archive', '<img src="old/x{id}.png">|archive', '<img src="https://e.com/y{id}.png">|failed'])
def asset_localisation(f):
    page = f.select("doc_id", F.concat(F.lit('<img src="'), "a", F.lit('">')).alias("html"), F.col("a").alias("src"), "b", urls.filename(F.col("a")).alias("n"))
    fetched = page.filter("b IN ('direct', 'both')").select(F.col("src").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("a/"), "n").alias("path"))
    old = page.filter("b IN ('archive', 'both')").select(F.col("src").alias("url"), F.concat(F.lit("old/"), "n").alias("path"))
    refs = page.select("doc_id", "src", F.lit("").alias("width"), F.lit("").alias("height"))
    done = consolidate.localise(refs, fetched, old)
    return consolidate.archive_pages(page.select("doc_id", "html"), done, "doc_id").join(done, "doc_id").select("doc_id", F.concat_ws("|", "html", "source").alias("value"))


@case("style_sheets", ["a{background:url('https://e.com/{id}.png')}", "b{background:url(data:x)} c{src:url(https://e.com/unknown)}"], ["a{background:url('l/{id}.png')}", "b{background:url(data:x)} c{src:url(https://e.com/unknown)}"])
def style_sheets(f):
    assets = f.select(F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("src"), F.concat(F.lit("l/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    done = consolidate.rewrite_css(f.select(F.col("doc_id").cast("string").alias("url"), F.col("a").alias("css")), assets)
    return done.select(F.col("url").cast("long").alias("doc_id"), F.col("css").alias("value"))


@case("asset_index", ["known", "new", "moved"], ["i/{id}.png|true|/i/{id}.png", "assets/posts/{id}/{id}.png|false|~", "g/{id}.png|true|/g/{id}.png"])
def asset_index(f):
    """Where wanted assets are kept, after a consolidation and by the index."""
    one = f.select("doc_id", "a", F.col("doc_id").cast("string").alias("slug"), F.concat(F.lit("https://e.com/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("url"))
    name = F.concat(F.col("slug"), F.lit(".png"))
    index = consolidate.record(one.limit(0).select("url", F.lit("x").alias("path")), one.filter("a <> 'new'").select("url", F.concat(F.lit("i/"), name).alias("path")))
    moves = one.filter("a = 'moved'").select(F.concat(F.lit("i/"), name).alias("path"), F.concat(F.lit("g/"), name).alias("new_path"))
    index = consolidate.promote(index, moves)
    kept = consolidate.allocate(one.select("url", "slug"), index).join(consolidate.resolve(one, index).select("url", "web_path"), "url")
    return kept.select(F.col("slug").cast("long").alias("doc_id"), shown("path", "known", "web_path").alias("value"))


@case("moved_references", ["../../Assets/{id}.png", "/assets/{id}.png", "other/{id}.png"], ["../../g/{id}.png", "/g/{id}.png", "other/{id}.png"])
def moved_references(f):
    moves = f.select(F.concat(F.lit("assets/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("g/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("new_path"))
    done = consolidate.move_references(f.select(F.col("doc_id").alias("slug"), F.col("a").alias("src")), moves)
    return done.select(F.col("slug").alias("doc_id"), F.col("new_src").alias("value"))


# ---- lists


@case("author_filters", [("Ann {id}", None), ("Bob", None), (None, "Fetch error")], ["true", "false", "true"])
def author_filters(f):
    """Discovered addresses by author; a short list is filtered, what could not be read stays."""
    found = f.select("doc_id", F.col("a").alias("author"), F.col("b").alias("error"))
    kept = posts.discovered_by(found, "ann", limit=2**31 - 2)
    return found.select("doc_id").join(kept.select("doc_id", F.lit(True).alias("k")), "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(False)).cast("string").alias("value"))


@case("scroll_anchors", [("The same first six words of this {id}", "The  Same first six words of that"), ("One {id}", "Two {id}")], ["1|5", "~|~"])
def scroll_anchors(f):
    page = f.select(F.col("doc_id").alias("slug"), F.lit(1).alias("pos"), F.col("a").alias("text"))
    text = f.select(F.col("doc_id").alias("slug"), F.lit(5).alias("pos"), F.col("b").alias("text"))
    return page.select("slug").join(posts.heading_anchors(page, text), "slug", "left").select(F.col("slug").alias("doc_id"), shown("html_pos", "md_pos").alias("value"))


@case("filtered_posts", [("1", "A"), ("0", "A"), ("1", "B")], ["true", "false", "false"])
def filtered_posts(f):
    """A list by status, author and type of issue together."""
    rows = f.select(F.col("doc_id").alias("slug"), F.col("a").cast("int").alias("html_issues"), F.col("b").alias("author"), F.lit(0).alias("md_issues"))
    kept = posts.filtered(rows, "html", "A", "t", rows.select("slug", F.lit("t").alias("type")))
    return rows.join(kept.select("slug", F.lit("true").alias("k")), "slug", "left").select(F.col("slug").alias("doc_id"), F.coalesce("k", F.lit("false")).alias("value"))


@F.pandas_udf(T.StringType())
def _diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([rewrite.diff(a, b) for a, b in zip(old, new)])


@case("text_diffs", [("a\nb{id}", "a\nc{id}"), ("same {id}", "same {id}")], ["--- old~+++ new~@@ -1,2 +1,2 @@~ a~-b{id}~+c{id}", ""])
def text_diffs(f):
    return f.select("doc_id", F.translate(_diff("a", "b"), "\n", "~").alias("value"))
