"""Page operators that rewrite trees: extraction, enrichment and conversion, one Python pass over Arrow batches each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import markdown, rewrite, urls
from leafmill.operators.nodes import map_rows, spread

META = "title string, date string, author string, categories array<string>, tags array<string>, site string"
STATS = ("pre_br_normalised", "code_classes_normalised", "youtube_replaced", "gists_replaced", "gists_failed", "code_fixed", "languages_detected", "embeds_replaced")


def extract_posts(fetched: DataFrame, short_slugs: bool = False) -> DataFrame:
    """Posts from fetched pages (url, status, body, and a fetch error or null).

    (url, title, date, author, categories, tags, site, html, asset_count, error, slug). A failed fetch gives its error,
    another status than 200 gives "HTTP n", a page without an article says so; none of them stops the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, status, body, error in zip(pdf["url"], pdf["status"], pdf["body"], pdf["error"]):
                failed = error if isinstance(error, str) and error else "" if status == 200 else f"HTTP {'' if pd.isna(status) else int(status)}".strip()
                found = {"title": "", "date": "", "author": "", "categories": [], "tags": [], "site": "", "html": "", "asset_count": 0} if failed else rewrite.extract(body)
                out.append({"url": url, **found, "error": failed or found.get("error", "")})
            yield pd.DataFrame(out, columns=["url", "title", "date", "author", "categories", "tags", "site", "html", "asset_count", "error"])

    posts = spread(fetched.select("url", "status", "body", "error")).mapInPandas(run, f"url string, {META}, html string, asset_count int, error string")
    posts = posts.withColumn("date", urls.iso_date(F.col("date")))
    return posts.withColumn("slug", urls.slug(F.col("url"), F.col("date"), short_slugs))


def enrich(pages: DataFrame, gists: DataFrame | None = None, key: str = "slug", html: str = "html") -> DataFrame:
    """(key, html, and a count of each kind of change). gists (gist_id, files array<struct<name,language,content>>) are
    joined to the pages by the ids that their scripts name, so that no page asks the network."""
    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(key, F.col(html).alias("html"))
    if gists is None:
        source = source.withColumn("known", F.array().cast("array<struct<gist_id:string,files:array<struct<name:string,language:string,content:string>>>>"))
    else:
        ids = F.array_distinct(F.regexp_extract_all("html", F.lit(r"gist\.github\.com/(?:[^/\"'?#]+/)?([0-9a-zA-Z]+)(?:\.js)?[\"'?#]"), 1))
        wanted = source.select(key, F.explode(ids).alias("gist_id")).join(gists, "gist_id")
        source = source.join(wanted.groupBy(key).agg(F.collect_list(F.struct("gist_id", "files")).alias("known")), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, page, known in zip(pdf[key], pdf["html"], pdf["known"]):
                files = {g["gist_id"]: [(f["name"], f["language"], f["content"]) for f in g["files"]] for g in (known if known is not None else [])}
                done, stats = rewrite.enrich(page, files)
                out.append((k, done if page is not None else None, *(stats[s] for s in STATS)))
            yield pd.DataFrame(out, columns=[key, "html", *STATS])

    return spread(source).mapInPandas(run, f"{key} {kind}, html string, " + ", ".join(f"{s} int" for s in STATS))


def convert(pages: DataFrame, key: str = "slug", html: str = "html", site_suffix: str | None = None, placeholders: bool = False) -> DataFrame:
    """(key, md) of pages with their metadata (title, date, author, categories, tags, original_url).

    Trees are rendered in Python; the last cleaning of lines stays in the JVM. A page without an article has null md.
    placeholders: leave a note for each lost image.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = ("title", "date", "author", "categories", "tags", "original_url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                meta = {n: (list(v) if n in ("categories", "tags") and v is not None else v) for n in names if (v := getattr(row, n)) is not None}
                out.append((getattr(row, key), rewrite.to_markdown(row.page, meta, site_suffix, placeholders)))
            yield pd.DataFrame(out, columns=[key, "md"])

    raw = spread(pages.select(key, F.col(html).alias("page"), *names)).mapInPandas(run, f"{key} {kind}, md string")
    head = F.regexp_extract("md", r"(?s)\A(---\n.*?\n---\n)", 1)
    return raw.select(key, F.concat(head, F.lit("\n"), markdown.clean(markdown.body(F.col("md"))), F.lit("\n")).alias("md"))


def fences(posts: DataFrame, key: str = "slug", md: str = "md") -> DataFrame:
    """(key, idx, start, end, language, content, fingerprint, sample) of the fenced blocks of each text."""
    kind = posts.schema[key].dataType.simpleString()

    found = map_rows(posts.select(key, md), lambda k, text: ((k, *f) for f in rewrite.fences(text)), f"{key} {kind}, idx int, start int, end int, language string, content string")
    return found.withColumns({"fingerprint": markdown.fingerprint(F.col("content")), "sample": F.substring("content", 1, 128)})


def pretty(html_column):
    """A column of pages with one element to a line where that adds no space, as raw text if the page is broken."""
    return F.regexp_replace(html_column, r"(?i)(</(?:p|div|li|ul|ol|h[1-6]|table|tr|pre|section|article|figure|blockquote)>)\s*(?=<)", "$1\n")


def without_archive_header(html_column):
    """A column of pages without the header that an archive put in."""
    return F.regexp_replace(html_column, r'(?is)<header[^>]*class="[^"]*archive-header[^"]*"[^>]*>.*?</header>', "")
