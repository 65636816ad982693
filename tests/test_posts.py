"""Markdown checks, refinement, state, assets, discovery and statistics on small tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import markdown, urls
from leafmill.operators import consolidate, pages, posts, refine, state, validate
from leafmill.plans import registry
from leafmill.sources import feeds, files

HEAD = "---\ntitle: T\ndate: 2020-01-01\nauthor: A\n---\n"
LONG = "This is a body of text that is long enough."
TEXTS = [
    (HEAD + LONG, set()), (LONG, {"front_matter_invalid"}), (HEAD.replace("date: 2020-01-01\n", "") + LONG, {"front_matter_invalid"}), (HEAD + "x", {"empty_body"}),
    (HEAD + LONG + "\n```java\na\n```\n", set()), (HEAD + LONG + "\n```java\na\n", {"unbalanced_fences"}), (HEAD + LONG + "\n````\n```\n````\n", {"empty_code_block"}), (HEAD + LONG + "\n```\n```\n", {"empty_code_block"}),
    (HEAD + LONG + "\n```zork\na\n```\n", {"code_fence_language"}), (HEAD + LONG + "\n```1\na\n```\n", {"stray_digit_after_fence", "code_fence_language"}), (HEAD + LONG + " @@CODEBLOCK_001@@", {"orphaned_placeholder"}),
    (HEAD + LONG + " [a]()", {"broken_md_links"}), (HEAD + LONG + "\n\n\n\n", {"no_triple_blanks"}), (HEAD + "a" * 8001, {"excessive_line_length"}), (HEAD + LONG + "&amp;" * 5, {"html_entities_in_body"}),
    (HEAD + LONG + " ../../assets/x", {"local_image_paths"}), (HEAD + LONG + " Post Comment", {"wordpress_junk"}), (HEAD + LONG + "MISSING_IMAGE" * 11, {"many_missing_images"}),
]


def test_markdown_checks(spark):
    made = spark.createDataFrame([(k, t[0]) for k, t in enumerate(TEXTS)] + [(99, None)], "slug int, md string")
    found = {}
    for r in validate.check(made).collect():
        found.setdefault(r["slug"], set()).add(r["check"])
    for k, (text, expected) in enumerate(TEXTS):
        assert found.get(k, set()) == expected, text[:200]
    assert 99 not in found


def test_cross_checks(spark):
    page = "<article><h2>One two three four five</h2>" + "<p>" + "word " * 200 + "</p><pre><code>int value = compute();</code></pre><ul><li>a</li><li>b</li></ul><p>This is the last paragraph of the whole page.</p></article>"
    good = HEAD + "## One two three four\n\n" + "word " * 200 + "\n\n```\nint value = compute();\n```\n\n* a\n* b\n\nThis is the last paragraph of the whole page."
    made = spark.createDataFrame([("good", good, page), ("bad", HEAD + "nothing of it is left here", page), ("none", good, None)], "slug string, md string, html string")
    found = {}
    for r in validate.cross_check(made.select("slug", "md"), made.select("slug", "html")).collect():
        found.setdefault(r["slug"], set()).add(r["check"])
    assert "good" not in found and found["none"] == {"cross_check_error"}
    assert found["bad"] >= {"word_count", "code_block_count", "heading_match", "last_section_present", "code_content_missing", "lists_dropped"}


def test_refine_and_replay(spark):
    prose = "This is a sentence of plain prose.\nAnd here is another line of it.\nx = 1"
    md = f"a\n```\nimport java.util.List;\n```\nb\n```text\n{prose}\n```\n"
    made = spark.createDataFrame([("s", md)], "slug string, md string")
    fences = pages.fences(made)
    suggestions = refine.suggest(fences)
    assert {(r["check"], r["fence_index"]) for r in suggestions.collect()} == {("language_tag_missing", 0), ("prose_in_code", 1)}
    rules = refine.build_rules(suggestions, fences)
    row = refine.replay(made, rules).first()
    assert "```java\nimport" in row["md"] and "And here is another line of it.\n\n```text\nx = 1" in row["md"] and not list(row["conflicts"])
    assert refine.replay(made, rules.limit(0)).first()["md"] == md
    gone = rules.withColumn("fingerprint", F.lit("0")).withColumn("content_sample", F.lit("zzzzzzzzzzzz" * 9))
    assert sorted(refine.replay(made, gone).first()["conflicts"]) == ["language_tag_missing@fence_0", "prose_in_code@fence_1"]
    moved = rules.withColumn("fence_index", F.col("fence_index") + 1)
    assert {(r["fence_index"], r["idx"]) for r in refine.match(moved, fences).collect()} == {(1, 0), (2, 1)}


@pytest.mark.parametrize("a, b, expected", [("abcd", "abxd", 0.75), ("", "", 1.0), ("a", "", 0.0), ("ab", "abcd", 0.5)])
def test_similarity(spark, a, b, expected):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(markdown.similarity(F.col("a"), F.col("b"))).first()[0] == expected


def test_clean(spark):
    raw = "Title\n=====\n[](http://x/y)kept\n[Post Comment]\n\n\n\ntext\n----\n"
    assert spark.createDataFrame([(raw,)], "md string").select(markdown.clean(F.col("md"))).first()[0] == "# Title\nkept\n\n## text"


def test_state_snapshots(spark):
    empty = spark.createDataFrame([], state.SCHEMA)
    at = F.lit(dt.datetime(2020, 1, 1))
    pages_ = spark.createDataFrame([("a", "<p>1</p>"), ("b", "<p>2</p>")], "slug string, html string")
    side = spark.createDataFrame([("a", "T", "2020-01-01", "Ann", "u")], "slug string, title string, date string, author string, original_url string")
    s = state.bootstrap(empty, pages_, side, at)
    assert {(r["slug"], r["title"]) for r in s.collect()} == {("a", "T"), ("b", "")}
    s = state.mark_generated(s, pages_.filter("slug = 'a'"), at)
    assert {r["slug"]: r["stale"] for r in state.with_stale(s).collect()} == {"a": False, "b": False}
    s = state.bootstrap(s, spark.createDataFrame([("a", "<p>changed</p>")], "slug string, html string"), side, at)
    assert {r["slug"]: r["stale"] for r in state.with_stale(s).collect()} == {"a": True, "b": False}
    patched = {r["slug"]: r for r in state.patch(s, spark.createDataFrame([("b", True, "hacked")], "slug string, reviewed boolean, title string")).collect()}
    assert patched["b"]["reviewed"] and patched["b"]["title"] == ""
    issues = spark.createDataFrame([("a", "x", "WARN", "d", None), ("a", "y", "WARN", "d", None)], "slug string, type string, level string, detail string, selector string")
    gone = spark.createDataFrame([("a", "x", dt.datetime(2020, 1, 1)), ("a", "z", dt.datetime(2020, 1, 1))], "slug string, type string, ts timestamp")
    s2 = state.set_html_issues(s, issues, gone, spark.createDataFrame([("a", "h")], "slug string, hash string"), at)
    assert [i["type"] for i in {r["slug"]: r for r in s2.collect()}["a"]["html"]["issues"]] == ["y"]
    assert [r["type"] for r in state.kept_dismissals(gone, issues).collect()] == ["x"]


def test_versions(spark):
    live = spark.createDataFrame([("a", 1, "live", "old")], "slug string, version int, status string, md string")
    staged = state.stage(live, spark.createDataFrame([("a", "new")], "slug string, md string"))
    chosen = spark.createDataFrame([("a",)], "slug string")
    assert {(r["status"], r["md"]) for r in state.accept(staged, chosen).collect()} == {("superseded", "old"), ("live", "new")}
    assert {(r["status"], r["md"]) for r in state.reject(staged, chosen).collect()} == {("live", "old")}


def test_consolidation(spark):
    made = spark.createDataFrame([("assets/posts/a/x.png", "a", "h1"), ("assets/posts/b/y.png", "b", "h1"), ("assets/posts/a/c/x.png", "a", "h2"), ("assets/posts/b/x.png", "b", "h2"), ("assets/posts/a/z.png", "a", "h3"), ("assets/posts/a/w.png", "a", "h3")], "path string, slug string, sha256 string")
    kept = spark.createDataFrame([("assets/global/x.png",)], "path string")
    moves = consolidate.plan(made, kept)
    got = {r["path"]: (r["new_path"], r["action"]) for r in moves.collect()}
    assert len(got) == 4 and {v[0] for v in got.values()} == {"assets/global/x-2.png", "assets/global/x-3.png"} and sum(v[1] == "move" for v in got.values()) == 2
    refs = spark.createDataFrame([("p", "../../assets/posts/B/Y.png"), ("p", "other.png")], "slug string, src string")
    assert {r["new_src"] for r in consolidate.move_references(refs, moves).collect()} == {"../../" + got["assets/posts/b/y.png"][0], "other.png"}


def test_discovery(spark):
    body = "<urlset><url><loc>https://a.b/2020/x</loc></url><url><loc>https://a.b/tag/y</loc></url></urlset>"
    bodies = spark.createDataFrame([("s", body), ("t", "not xml <url"), ("n", None)], "site string, body string")
    assert [r["url"] for r in feeds.sitemap_urls(bodies).collect()] == ["https://a.b/2020/x"]
    feed = spark.createDataFrame([("s", "<rss><item><title>t</title><link>https://a.b/1</link></item></rss>"), ("t", '<feed><entry><link rel="alternate" href="https://c.d/2"/></entry></feed>')], "site string, body string")
    assert {(r["site"], r["url"]) for r in feeds.feed_links(feed).collect()} == {("s", "https://a.b/1"), ("t", "https://c.d/2")}
    rest = spark.createDataFrame([("s", '[{"link":"https://a.b/3"},{"link":""}]'), ("t", "oops")], "site string, body string")
    assert [r["url"] for r in feeds.rest_links(rest).collect()] == ["https://a.b/3"]
    index = spark.createDataFrame([("s", "<sitemapindex><sitemap><loc>https://a.b/post-sitemap.xml</loc></sitemap><sitemap><loc>https://a.b/page.xml</loc></sitemap></sitemapindex>")], "site string, body string")
    assert [r["url"] for r in feeds.sitemap_index(index).collect()] == ["https://a.b/post-sitemap.xml"]
    probes = spark.createDataFrame([("https://w.x", 200, '{"name":"W"}', ""), ("https://y.blogspot.com", 404, "", "<title>Y</title>"), ("https://g.h", 404, None, '<meta name="generator" content="Ghost 5">')], "site string, rest_status int, rest_body string, page_body string")
    assert {r["site"]: (r["platform"], r["name"]) for r in feeds.platform(probes).collect()} == {"https://w.x": ("wordpress", "W"), "https://y.blogspot.com": ("blogger", "Y"), "https://g.h": ("ghost", "g.h")}


def test_url_functions(spark):
    row = spark.createDataFrame([("https://www.youtube.com/watch?v=ab&t=1", "https://youtu.be/cd", "https://gist.github.com/u/12.js", "http://www.A.b/x/", "../..%2fetc")], "a string, b string, c string, d string, e string").select(
        urls.youtube_id(F.col("a")), urls.youtube_id(F.col("b")), urls.gist_id(F.col("c")), urls.domain(F.col("d")), urls.normalise(F.col("d")), urls.traversal(F.col("e")), urls.project_id(F.lit("My  Blog!")), urls.stored_path(F.lit("/r/x"), F.lit("/r")), urls.stored_path(F.lit("/q"), F.lit("/r"))
    ).first()
    assert tuple(row) == ("ab", "cd", "12", "a.b", "http://www.A.b/x", True, "my-blog", "x", "/q")


def test_fetch_keeps_errors(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return 200, "body"

    rows = {r["url"]: r for r in files.fetch(spark.createDataFrame([("http://ok",), ("http://bad",)], "url string"), get).collect()}
    assert rows["http://ok"]["status"] == 200 and rows["http://bad"]["error"] == "Fetch error: no route"


def test_file_sources_and_stream(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.html").write_text("<article>x</article>")
    (tmp_path / "posts" / "a.json").write_text('{"title": "T", "tags": ["x"]}')
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "posts")).collect()] == [("a", "<article>x</article>")]
    assert files.read_sidecars(spark, str(tmp_path / "posts")).first()["title"] == "T"
    (tmp_path / "state.json").write_text('{"a": {"title": "T", "html": {"hash": "h"}}}')
    assert files.read_state(spark, str(tmp_path / "state.json")).first()["html"]["hash"] == "h"
    from leafmill.streaming.ingest import Ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"url": "https://a.b/one", "status": 200, "body": "<article><h1>One</h1></article>", "fetched_at": "2020-01-01T00:00:00Z"}\n{"url": "https://a.b/two", "status": 500}\n')
    job = Ingest(spark, "p", str(tmp_path / "in"), str(tmp_path / "out"))
    job.start().awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text('{"url": "https://a.b/one", "status": 200, "body": "<article><h1>Two</h1></article>", "fetched_at": "2020-01-02T00:00:00Z"}\n')
    job.start().awaitTermination(120)
    assert [(r["slug"], r["title"]) for r in job.posts().collect()] == [("one", "Two")]
    assert [r["error"] for r in job.errors().collect()] == ["HTTP 500"]


def test_lists_and_search(spark):
    made = spark.createDataFrame([("a", "Hello", "text", "Ann", "2020-01-02"), ("b", "World", None, "Bob", "2020-01-01")], "slug string, title string, md string, author string, date string")
    assert [r["slug"] for r in posts.listed(made).collect()] == ["b", "a"]
    found = lambda q, s: sorted(r["slug"] for r in posts.search(made, q, s).collect())
    assert (found("", "both"), found("hELLO", "title"), found("text", "title"), found("TEXT", "both")) == (["a", "b"], ["a"], [], ["a"])
    issues = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "slug string, type string")
    assert [tuple(r) for r in posts.breakdown(issues).collect()] == [("x", 2), ("y", 1)]
    assert [tuple(r) for r in posts.breakdown(issues, made, "Ann").collect()] == [("x", 1)]


CHEAP = [n for n in registry.oracle_sql() if not n.startswith(("issue", "dismissals"))]


@pytest.mark.parametrize("name", [*CHEAP, "issue_breakdown"])
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = registry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, expected))


def test_projects(tmp_path):
    from leafmill.sources.projects import Projects

    index = Projects(str(tmp_path / "all"))
    assert index.list() == [] and index.activate() is None
    a, b = index.create("My  Blog!"), index.create("My Blog")
    assert (a["id"], b["id"]) == ("my-blog", "my-blog-2") and index.activate().enriched_dir.name == "enriched" and index.active == "my-blog"
    changed = index.patch_config("my-blog", {"serve_root": "/srv", "output": {"md_dir": "/abs/md"}})
    assert str(changed.posts_dir) == "/srv/legacy/posts" and str(changed.md_dir) == "/abs/md"
    assert index.delete("my-blog") and not index.delete("my-blog") and [p["id"] for p in index.list()] == ["my-blog-2"]


def test_missing_images_are_noted():
    from leafmill.functions import rewrite

    page = "<article><p>See the image below</p><p>x</p><img src='data:image/gif' alt='a cat'><noscript><img src='https://a.b/c.png'></noscript></article>"
    md = rewrite.to_markdown(page, {}, placeholders=True)
    assert md.count("> Missing image:") == 3 and "a cat" in md and "https://a.b/c.png" in md
    assert "Missing image" not in rewrite.to_markdown(page, {})
