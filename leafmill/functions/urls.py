"""URL functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of tracking pixels.
TRACKING_DOMAINS = (
    "stats.wordpress.com", "pixel.wp.com", "pixel.quantserve.com", "b.scorecardresearch.com", "beacon.krxd.net", "ad.doubleclick.net", "googleads.g.doubleclick.net", "google-analytics.com",
    "connect.facebook.net", "platform.twitter.com", "bat.bing.com", "ct.pinterest.com", "analytics.twitter.com", "px.ads.linkedin.com", "mc.yandex.ru", "counter.yadro.ru",
)
# Path segments of pages that are no posts.
NOT_POSTS = ("category", "tag", "author", "page", "feed", "wp-content", "wp-includes", "wp-admin", "comment-page", "attachment")


def host(url: Column) -> Column:
    """The host in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """The path, empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    """The non-blank parts of the path."""
    return F.filter(F.split(path(url), "/"), lambda s: F.trim(s) != "")


def normalise(url: Column, to_https: bool = False) -> Column:
    """Trimmed, without slashes at the end; a bare domain gets https, and http only if asked for."""
    plain = F.regexp_replace(F.trim(url), "/+$", "")
    plain = F.when(plain.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://") | (plain == ""), plain).otherwise(F.concat(F.lit("https://"), plain))
    return F.regexp_replace(plain, "^http://", "https://") if to_https else plain


def iso_date(raw: Column) -> Column:
    """A leading YYYY-MM-DD, else the trimmed text."""
    found = F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(F.trim(F.coalesce(raw, F.lit(""))))


def slug(url: Column, date: Column | None = None, short: bool = False) -> Column:
    """The last path segment in lower case with hyphens, else the start of the URL's hash; with the date before it.

    short drops .htm and .html, marks a missing date as undated, and keeps 80 characters.
    """
    last = F.lower(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("")))
    if short:
        last = F.regexp_replace(last, r"\.html?$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "")
    clean = F.when(clean == "", F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 8)).otherwise(clean)
    if date is None and not short:
        return clean
    day = iso_date(date) if date is not None else F.lit("")
    named = F.when(day != "", F.concat_ws("-", day, clean)).otherwise(F.concat(F.lit("undated-"), clean) if short else clean)
    return F.substring(named, 1, 80) if short else named


def filename(url: Column) -> Column:
    """What follows the last slash of the path, or of the whole text where it is no URL."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", "")
    return F.regexp_extract(plain, "([^/]*)$", 1)


def safe_filename(url: Column) -> Column:
    """A file name of letters, digits, dots, hyphens and underscores, at most 120 characters."""
    name = F.regexp_replace(filename(url), r"[^\w.-]", "_")
    return F.substring(F.when(name == "", "asset").otherwise(name), 1, 120)


def suffix(name: Column) -> Column:
    """The last extension with its dot, empty if there is none."""
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def is_post(url: Column) -> Column:
    """An http address without .. and without a segment of lists, with a year or any segment in its path."""
    plain = url.rlike("^https?://") & ~url.contains("..")
    listed = F.exists(F.transform(segments(url), F.lower), lambda s: s.isin(*NOT_POSTS))
    return F.coalesce(plain & ~listed & (path(url).rlike(r"/\d{4}/") | (F.size(segments(url)) >= 1)), F.lit(False))


def is_tracking_pixel(src: Column, width: Column, height: Column) -> Column:
    """A known tracking host, or an http image of at most one pixel each way."""
    tiny = F.trim(width).isin("0", "1") & F.trim(height).isin("0", "1")
    return F.coalesce(domain(src).isin(*TRACKING_DOMAINS) | (tiny & src.startswith("http")), F.lit(False))


def youtube_id(url: Column) -> Column:
    """The video's id of a watch, embed or short address, else null."""
    at = domain(url)
    short = F.when(at == "youtu.be", F.regexp_extract(path(url), "^/([^/]+)", 1))
    watch = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    embed = F.regexp_extract(path(url), "^/embed/([^/]+)", 1)
    full = F.when(at.isin("youtube.com", "m.youtube.com", "youtube-nocookie.com"), F.coalesce(F.nullif(embed, F.lit("")), watch))
    return F.nullif(F.coalesce(short, full), F.lit(""))


def gist_id(url: Column) -> Column:
    """The id of a gist's address with or without the user and the script suffix, else null."""
    last = F.regexp_replace(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("")), r"\.js$", "")
    return F.when(domain(url) == "gist.github.com", F.nullif(last, F.lit("")))


def asset_path(url: Column, date: Column, root: str = "/assets/images") -> Column:
    """Where a page's asset is kept: by year and month, with the start of the URL's hash before its name."""
    day = iso_date(date)
    name = F.substring(safe_filename(url), 1, 60)
    return F.concat_ws("/", F.lit(root), F.when(day.rlike(r"^\d{4}-\d{2}"), F.concat_ws("/", F.substring(day, 1, 4), F.substring(day, 6, 2))).otherwise("undated"), F.concat(F.substring(F.sha2(url, 256), 1, 12), F.lit("-"), name))


def project_id(name: Column) -> Column:
    """A project's id from its name: lower case, hyphens, at most 40 characters."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(clean, 1, 40), "-$", "")


def stored_path(target: Column, root: Column) -> Column:
    """A path as a project stores it: . for the root, relative inside it, absolute elsewhere or without a root."""
    inside = target.startswith(F.concat(root, F.lit("/")))
    return F.when(root.isNull() | (root == ""), target).when(target == root, F.lit(".")).when(inside, F.substring(target, F.char_length(root) + 2, F.char_length(target))).otherwise(target)


def traversal(path: Column) -> Column:
    """Whether a decoded request path would leave its root."""
    plain = F.coalesce(F.try_url_decode(path), path)
    return F.exists(F.split(plain, r"[/\\]"), lambda s: s == "..")
