"""Assets: equal files by content, the plan that keeps one copy, and the addresses that move."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import urls


def groups(files: DataFrame) -> DataFrame:
    """(sha256, primary, slugs, copies) of contents in the folders of two posts or more (path, slug, sha256). The first
    path by name is the primary copy."""
    return files.groupBy("sha256").agg(F.min("path").alias("primary"), F.count_distinct("slug").alias("slugs"), F.count("*").alias("copies")).filter("slugs >= 2")


def plan(files: DataFrame, kept: DataFrame | None = None, root: str = "assets/global") -> DataFrame:
    """(path, new_path, action): the primary copy of each group moves to the root, its copies are deleted.

    The first group of a name keeps it, by the path of its primary copy, unless the root has it already (kept: path);
    the others get the smallest numbers from 2 on before the extension that no file of the root or other group has.
    So all targets are distinct.
    """
    found = groups(files).withColumn("name", urls.filename(F.col("primary")))
    found = found.withColumns({"end": urls.suffix(F.col("name")), "place": F.row_number().over(Window.partitionBy("name").orderBy("primary"))})
    found = found.withColumn("base", F.substring("name", F.lit(1), F.char_length("name") - F.char_length("end")))
    there = (kept.select(urls.filename(F.col("path")).alias("name")) if kept is not None else found.select("name").limit(0)).distinct()
    names = found.select("name").union(there).distinct()
    numbered = names.select(F.regexp_extract("name", r"^(.*)-\d{1,9}(\.[^./]+)?$", 1).alias("base"), urls.suffix(F.col("name")).alias("end"), F.regexp_extract("name", r"-(\d{1,9})(?:\.[^./]+)?$", 1).try_cast("long").alias("k")).filter("k IS NOT NULL")
    used = numbered.groupBy("base", "end").agg(F.collect_set("k").alias("used"))
    found = found.join(there.withColumn("held", F.lit(1)), "name", "left").join(used, ["base", "end"], "left")
    nth = F.col("place") - F.when(F.col("held").isNull(), 1).otherwise(0)  # of those that need a number
    used = F.coalesce("used", F.array().cast("array<bigint>"))
    free = F.array_except(F.sequence(F.lit(2).cast("long"), nth + F.size(used) + 1), used)
    target = F.when(nth == 0, F.col("name")).otherwise(F.concat("base", F.lit("-"), F.get(free, (nth - 1).cast("int")).cast("string"), "end"))
    named = found.select("sha256", "primary", F.concat(F.lit(f"{root}/"), target).alias("new_path"))
    return files.join(named, "sha256").select("path", "new_path", F.when(F.col("path") == F.col("primary"), "move").otherwise("delete").alias("action"))


def move_index(index: DataFrame, moves: DataFrame) -> DataFrame:
    """The index of addresses (url, path) with moved paths."""
    return index.join(moves.select("path", "new_path"), "path", "left").select("url", F.coalesce("new_path", "path").alias("path"))


def move_references(refs: DataFrame, moves: DataFrame) -> DataFrame:
    """References in pages (slug, src) with moved paths, whatever their case: extracted paths meet the moves in an
    equi-join, no page is searched for every path."""
    key = F.lower(F.regexp_replace("src", r"^(\.\./)+|^/", ""))
    old = moves.select(F.lower("path").alias("k"), "new_path")
    return refs.withColumn("k", key).join(old, "k", "left").select("slug", "src", F.coalesce(F.concat(F.regexp_extract("src", r"^((?:\.\./)+|/)?", 1), F.col("new_path")), F.col("src")).alias("new_src"))


def allocate(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(url, slug, path, known): where each wanted asset (url, slug) is kept: where the index has it, else with its post."""
    fresh = F.concat(F.lit("assets/posts/"), F.col("slug"), F.lit("/"), urls.safe_filename(F.col("url")))
    return wanted.join(index.withColumnRenamed("path", "old"), "url", "left").select("url", "slug", F.coalesce("old", fresh).alias("path"), F.col("old").isNotNull().alias("known"))


def references(nodes: DataFrame) -> DataFrame:
    """(key, src, width, height) of images, and of links to images, in the relation of elements."""
    from leafmill.operators.nodes import attr

    key = nodes.columns[0]
    linked = attr("href").rlike(r"(?i)\.(?:png|jpe?g|gif|webp|svg)(?:[?#].*)?$")
    src = F.when(F.col("tag") == "img", attr("src")).when((F.col("tag") == "a") & linked, attr("href"))
    return nodes.filter(F.col("tag").isin("img", "a")).select(key, src.alias("src"), attr("width").alias("width"), attr("height").alias("height")).filter("src IS NOT NULL AND src <> ''")


def localise(refs: DataFrame, fetched: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """(key, src, path, source) of references by what was fetched of them (url, status, path): directly, else from the
    archive (url, path); one host of images is asked of the archive first. Each address counts once a page."""
    key = refs.columns[0]
    once = refs.filter(~urls.is_tracking_pixel(F.col("src"), F.col("width"), F.col("height"))).select(key, "src").distinct()
    direct = once.join(fetched.filter("status = 200").select(F.col("url").alias("src"), F.col("path").alias("direct")), "src", "left")
    both = direct.join(archived.select(F.col("url").alias("src"), F.col("path").alias("old")), "src", "left") if archived is not None else direct.withColumn("old", F.lit(None).cast("string"))
    first = F.when(F.contains("src", F.lit("imgur.com")), F.coalesce("old", "direct")).otherwise(F.coalesce("direct", "old"))
    return both.select(key, "src", first.alias("path"), F.when(first == F.col("direct"), "direct").when(first == F.col("old"), "archive").otherwise("failed").alias("source"))


def rewrite_css(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """Style sheets (url, css) with the addresses in url(...) that assets (src, path) has replaced by local ones."""
    found = F.regexp_extract_all("css", F.lit(r"url\(\s*['\"]?([^)'\"]+)['\"]?\s*\)"), 1)
    refs = sheets.select("url", F.explode(F.array_distinct(found)).alias("src")).filter(~F.col("src").startswith("data:") & ~F.col("src").startswith("#"))
    known = refs.join(assets, "src").groupBy("url").agg(F.collect_list(F.struct("src", "path")).alias("known"))
    swapped = F.aggregate(F.coalesce("known", F.array().cast("array<struct<src:string,path:string>>")), F.col("css"), lambda css, k: F.replace(css, k["src"], k["path"]))
    return sheets.join(known, "url", "left").select("url", swapped.alias("css"))


def archive_pages(pages: DataFrame, moved: DataFrame, key: str = "slug", html: str = "html") -> DataFrame:
    """(key, html) of pages whose src and href addresses that moved names (key, src, path) are replaced by local paths;
    a page travels with its own few addresses in one row."""
    own = moved.filter("path IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct(F.length("src").alias("n"), "src", "path")).alias("known"))
    known = F.coalesce("known", F.array().cast("array<struct<n:int,src:string,path:string>>"))
    swapped = F.aggregate(known, F.col(html), lambda page, k: F.replace(F.replace(page, F.concat(F.lit('="'), k["src"], F.lit('"')), F.concat(F.lit('="'), k["path"], F.lit('"'))), F.concat(F.lit("='"), k["src"], F.lit("'")), F.concat(F.lit("='"), k["path"], F.lit("'"))))
    return pages.join(own, key, "left").select(key, swapped.alias(html))


def promote(index: DataFrame, moves: DataFrame) -> DataFrame:
    """The index of addresses (url, path) after a consolidation plan: paths that moved or whose copies went."""
    return move_index(index, moves)


def resolve(wanted: DataFrame, index: DataFrame, root: str = "/") -> DataFrame:
    """(url, path, web_path) of addresses (url): where the index keeps them, null where it doesn't."""
    return wanted.select("url").join(index, "url", "left").select("url", "path", F.concat(F.lit(root), "path").alias("web_path"))


def record(index: DataFrame, stored: DataFrame) -> DataFrame:
    """The index with newly stored assets (url, path); an address that it has already keeps its path."""
    new = stored.select("url", "path").dropDuplicates(["url"]).join(index.select("url"), "url", "left_anti")
    return index.select("url", "path").unionByName(new)
