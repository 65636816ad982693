"""Discovery of posts: sitemaps, feeds and REST lists parsed from fetched bodies, and the cascade that picks one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import urls


def _texts(pattern: str) -> Column:
    """A column of the texts that a pattern's group finds in body, unescaped and trimmed; malformed bodies give few or none."""
    raw = F.transform(F.regexp_extract_all("body", F.lit(pattern), 1), lambda x: F.trim(F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    return F.filter(F.transform(raw, _unescaped), lambda x: x != "")


def _unescaped(text: Column) -> Column:
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _rows(bodies: DataFrame, links: Column) -> DataFrame:
    return bodies.select("site", F.posexplode(links).alias("pos", "url"))


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(site, pos, url) of the posts in sitemaps (site, body)."""
    return _rows(bodies, _texts(r"(?is)<url\b[^>]*>.*?<loc\b[^>]*>(.*?)</loc>")).filter(urls.is_post(F.col("url")))


def sitemap_index(bodies: DataFrame) -> DataFrame:
    """(site, pos, url) of the sitemaps in sitemap indexes; those with post in their address if there are any."""
    found = _rows(bodies, _texts(r"(?is)<sitemap\b[^>]*>.*?<loc\b[^>]*>(.*?)</loc>"))
    posts = F.max(F.contains("url", F.lit("post"))).over(Window.partitionBy("site"))
    return found.withColumn("any", posts).filter(~F.col("any") | F.contains("url", F.lit("post"))).select("site", "pos", "url")


def feed_links(bodies: DataFrame) -> DataFrame:
    """(site, pos, url) of the items of RSS and then the entries of Atom."""
    rss = _texts(r"(?is)<item\b[^>]*>.*?<link\b[^>]*>(.*?)</link>")
    atom = _texts(r"(?is)<entry\b[^>]*>(?:(?!</entry>).)*?<link\b(?![^>]*rel=[\"'](?:self|edit|replies))[^>]*href=[\"']([^\"']+)[\"']")
    return _rows(bodies, F.concat(rss, atom))


def rest_links(bodies: DataFrame) -> DataFrame:
    """(site, pos, url) of the posts in REST lists; a body that is no list gives none."""
    return _rows(bodies, F.filter(F.transform(F.from_json("body", "array<struct<link:string>>"), lambda x: x["link"]), lambda x: x.isNotNull() & (F.trim(x) != "")))


def rest_pages(site: str, n: int, size: int = 100) -> list[str]:
    """The addresses of the first n pages of a REST list."""
    return [f"{site}/wp-json/wp/v2/posts?per_page={size}&page={k}&_fields=link" for k in range(1, n + 1)]


def platform(probes: DataFrame) -> DataFrame:
    """(site, platform, name) by what was fetched of sites: (site, rest_status, rest_body, page_body)."""
    at, generator = urls.host(F.col("site")), F.lower(F.regexp_extract("page_body", r"(?is)<meta[^>]*name=[\"']generator[\"'][^>]*content=[\"']([^\"']*)", 1))
    rest = F.try_parse_json("rest_body").isNotNull() & (F.col("rest_status") == 200)
    kind = F.when(rest, "wordpress").when(F.contains(at, F.lit("blogger.com")) | F.contains(at, F.lit("blogspot.com")), "blogger").when(F.contains(generator, F.lit("ghost")), "ghost").otherwise("generic")
    og = F.regexp_extract("page_body", r"(?is)<meta[^>]*property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']*)", 1)
    title = F.trim(F.regexp_extract("page_body", r"(?is)<title[^>]*>(.*?)</title>", 1))
    named = F.coalesce(F.when(rest, F.nullif(F.get_json_object("rest_body", "$.name"), F.lit(""))), F.nullif(F.trim(og), F.lit("")), F.nullif(title, F.lit("")), at)
    return probes.select("site", F.coalesce(kind, F.lit("generic")).alias("platform"), named.alias("name"))


def dedupe_ordered(found: DataFrame) -> DataFrame:
    """One row for each address of a site, at its first place."""
    w = Window.partitionBy("site", "url").orderBy("pos")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def cascade(*sources: DataFrame) -> DataFrame:
    """(site, pos, url) of the first source that has any address of the site, without repeats and in its order."""
    ranked = None
    for rank, found in enumerate(sources):
        one = found.select("site", "pos", "url", F.lit(rank).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.withColumn("best", F.min("rank").over(Window.partitionBy("site"))).filter("rank = best")
    return dedupe_ordered(best.select("site", "pos", "url"))


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, ref: pd.Series) -> pd.Series:
    """Addresses against the page that they are on."""
    from urllib.parse import urljoin

    return pd.Series([urljoin(b or "", r or "") for b, r in zip(base, ref)])
