"""Lists, search, filters and statistics over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(posts: DataFrame, author: str | None = None) -> DataFrame:
    """Posts by date and slug, of one author if given."""
    return (posts.filter(F.col("author") == author) if author else posts).orderBy("date", "slug")


def discovered_by(urls: DataFrame, author: str | None, limit: int = 50) -> DataFrame:
    """Discovered addresses (url, author, error) whose author has the text in any case; unread ones stay. Lists of
    more than limit addresses are not filtered, as the source's own rule has it."""
    if not author or urls.limit(limit + 1).count() > limit:
        return urls
    return urls.filter(F.col("error").isNotNull() | F.contains(F.lower("author"), F.lit(author.lower())))


def search(posts: DataFrame, query: str, scope: str = "both") -> DataFrame:
    """Slugs whose title, body (column md) or either holds the text in any case; all for an empty text."""
    if not query.strip():
        return posts.select("slug")
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.strip().lower())), F.lit(False))
    wanted = {"title": has("title"), "body": has("md"), "both": has("title") | has("md")}[scope]
    return posts.filter(wanted).select("slug")


def badge(staged: Column, stale: Column, issues: Column, reviewed: Column, generated: Column) -> Column:
    """The one mark of a post, by rank."""
    return F.when(staged, "Staged").when(stale, "Stale").when(issues > 0, "Issues").when(reviewed, "Reviewed").when(generated, "Generated").otherwise("None")


#: Filters of a list over columns html_issues, md_issues, stale, staged, generated.
STATUS = {
    "all": lambda: F.lit(True), "html": lambda: F.col("html_issues") > 0, "md": lambda: F.col("md_issues") > 0, "stale": lambda: F.col("stale") & ~F.col("staged"),
    "staged": lambda: F.col("staged"), "no_md": lambda: ~F.col("generated"),
}


def filtered(posts: DataFrame, status: str = "all", author: str | None = None, issue_type: str | None = None, issues: DataFrame | None = None, query: str = "", scope: str = "both") -> DataFrame:
    """Posts that pass a status, an author, a type of issue and a search together."""
    out = posts.filter(STATUS[status]())
    if author:
        out = out.filter(F.col("author") == author)
    if issue_type and issues is not None:
        out = out.join(issues.filter(F.col("type") == issue_type).select("slug").distinct(), "slug", "left_semi")
    return out.join(search(posts, query, scope).distinct(), "slug", "left_semi") if query.strip() else out


def breakdown(issues: DataFrame, posts: DataFrame | None = None, author: str | None = None) -> DataFrame:
    """(type, posts): how many posts have each type of issue, most first; of one author if given."""
    if author and posts is not None:
        issues = issues.join(posts.filter(F.col("author") == author).select("slug"), "slug", "left_semi")
    return issues.groupBy("type").agg(F.count_distinct("slug").alias("posts")).orderBy(F.desc("posts"), "type")


def rollup(issues: DataFrame, posts: DataFrame) -> DataFrame:
    """(author, type, posts) with totals by author and over all."""
    return issues.join(posts.select("slug", "author"), "slug").rollup("author", "type").agg(F.count_distinct("slug").alias("posts"))


def stats(posts: DataFrame) -> DataFrame:
    """One row of totals over posts."""
    return posts.agg(
        F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if("staged").alias("staged"), F.count_if("generated").alias("md_generated"), F.count_if(F.col("html_issues") > 0).alias("html_issues")
    )


def project_list(projects: DataFrame, posts: DataFrame, active: str | None = None) -> DataFrame:
    """Projects with their totals (posts have a column project_id) and which is active; the first if none is named."""
    own = posts.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if("staged").alias("staged"))
    joined = projects.join(own, projects["id"] == own["project_id"], "left").na.fill(0, ["total", "reviewed", "staged"]).drop("project_id")
    chosen = F.lit(active) if active else F.lit((projects.agg(F.min_by("id", "created_at")).first() or [None])[0])
    return joined.withColumn("active", F.coalesce(F.col("id") == chosen, F.lit(False)))


def authors(posts: DataFrame) -> DataFrame:
    return posts.select("author").filter("author <> ''").distinct()


def heading_anchors(html_headings: DataFrame, md_headings: DataFrame, key: str = "slug") -> DataFrame:
    """(key, anchor, html_pos, md_pos): headings (key, pos, text) of page and text with the same first six words, the
    first of each, for scrolling both together."""
    name = F.array_join(F.slice(F.split(F.trim(F.lower("text")), r"\s+"), 1, 6), " ")
    one = lambda df, c: df.groupBy(key, name.alias("anchor")).agg(F.min("pos").alias(c))
    return one(html_headings, "html_pos").join(one(md_headings, "md_pos"), [key, "anchor"])
