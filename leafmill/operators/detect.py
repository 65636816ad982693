"""Defect detectors: each is a filter and projection over the relation of page elements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import dom, urls
from leafmill.operators.nodes import attr, count_inside, within

# Selectors and texts of a blog's chrome.
CHROME_SELECTORS = (
    ".entry-header", ".entry-meta", ".author-box", ".author-description", ".author-info", ".addtoany_share_save_container", ".sharedaddy",
    "#comments", ".comments-area", ".jp-relatedposts", ".post-navigation", ".wpdiscuz-form-container", "[class*=wpDiscuz]", "[class*=addtoany]",
)
CHROME_TEXTS = (r"(?i)^by\s+[A-Z]", "(?i)View all posts by", "(?i)Post Comment", "(?i)Leave a Reply", "(?i)You might also like", "(?i)Share this:")
BYLINE = r"(?i)^by\s+[A-Z]"
# Texts that announce an image.
IMAGE_SIGNALS = (
    "(?i)as shown (below|above|here)", "(?i)(see|view) (the )?(image|screenshot|figure|diagram|chart|graph|photo) (below|above)",
    "(?i)(the )?(following|below) (image|screenshot|figure|diagram|chart|graph) shows?", r"(?i)(image|screenshot|figure|diagram|chart|graph|photo):?\s*$", "(?i)click (to )?(enlarge|zoom|view)",
)
# Texts that look like code; one strong or two weak ones suffice.
STRONG_CODE = (r'(?i)\brule[\s ]*"', r"(?m)^\s*when\s*$", r"(?m)^\s*then\s*$", r"\bpublic\s+(class|static\s+void|interface)\b", r"\bimport\s+[\w.]+;", r"<\?xml\b", r"<[a-zA-Z][a-zA-Z0-9:._-]*\b[^>]+/>")
WEAK_CODE = (r"(?m)^\s*end\s*$", r"\bnew\s+\w+\s*\(", r"<[a-zA-Z][a-zA-Z0-9]*\b[^>]*/?>", r"(?m)[;{}]\s*$")
# An escaped tag in code, and signs of code that lost its line ends.
ENCODED_TAG = r"(?i)&lt;(?:\?xml|table|div|p|span|ul|ol|li|section|article|h[1-6]|tr|td|th)\b"
LOST_LINES = r"[;{}]|when\s+\w|\bthen\b|\bend\b"

@dataclass(frozen=True)
class Rule:
    """What one detector says of an element: when it fires, how bad that is, and its words."""

    when: Column
    level: str | Column
    detail: Column


def _cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def _tag(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def data_placeholder() -> list[Rule]:
    """Images whose source is still inline placeholder data."""
    return [Rule(_tag("img") & attr("src").startswith("data:"), "ERROR", F.format_string('Image is a lazy-load placeholder, alt="%s"', _cut(attr("alt"), 60)))]


def noscript_remnant() -> list[Rule]:
    """noscript elements that hold an image address."""
    url = F.regexp_extract("outer_html", "src=[\"']?(https?://[^\"'>\\s]+)", 1)
    return [Rule(_tag("noscript") & (url != ""), "WARN", F.concat(F.lit("Image address in noscript: "), _cut(url, 80)))]


def external_image() -> list[Rule]:
    """Images from elsewhere that are not of one pixel."""
    tiny = attr("width").isin("0", "1") & attr("height").isin("0", "1")
    return [Rule(_tag("img") & attr("src").startswith("http") & ~tiny, "WARN", F.concat(F.lit("Image is not local: "), _cut(attr("src"), 80)))]


def _tracks() -> Column:
    return urls.is_tracking_pixel(attr("src"), attr("width"), attr("height"))


def tracking_pixel() -> list[Rule]:
    """Images that only track."""
    at = F.coalesce(F.nullif(urls.domain(attr("src")), F.lit("")), F.lit("unknown"))
    return [Rule(_tag("img") & _tracks(), "WARN", F.concat(F.lit("Tracking pixel from "), at, F.lit(": "), _cut(attr("src"), 60)))]


def empty_embed() -> list[Rule]:
    """iframes without a source; a warning if a deferred one is there."""
    bare, late = _tag("iframe") & (F.trim(attr("src")) == ""), F.trim(attr("data-src"))
    title = F.coalesce(F.nullif(attr("title"), F.lit("")), F.get("classes", F.lit(0)), F.lit("iframe"))
    return [
        Rule(bare & (late == ""), "ERROR", F.format_string('iframe without a source, title="%s"', _cut(title, 40))),
        Rule(bare & (late != ""), "WARN", F.concat(F.lit("iframe has only data-src: "), _cut(late, 60))),
    ]


def unreplaced_gist() -> list[Rule]:
    """Scripts that would load a gist."""
    return [Rule(_tag("script") & attr("src").contains("gist.github.com"), "ERROR", F.concat(F.lit("Gist is not inlined: "), _cut(attr("src"), 80)))]


def _fits(simple: str) -> Column:
    """Whether an element fits a selector of one class, id or part of a class."""
    if simple.startswith("."):
        return F.array_contains("classes", simple[1:])
    if simple.startswith("#"):
        return attr("id") == simple[1:]
    return attr("class").contains(simple[8:-1])


def wordpress_chrome() -> list[Rule]:
    """Elements of the blog's chrome, one issue for each selector that fits, and short texts of it."""
    by_selector = [Rule(_fits(s) & (F.char_length("text") >= 3), "WARN", F.format_string('Page chrome (%s): "%s"', F.lit(s), _cut(F.col("text"), 50))) for s in CHROME_SELECTORS]
    short = F.trim(F.regexp_replace("whole_text", r"\s+", " "))
    return [*by_selector, Rule(_tag("p", "div", "span") & (F.char_length(short) <= dom.SHORT) & _any(short, CHROME_TEXTS), "WARN", F.format_string('Metadata in the article: "%s"', _cut(short, 60)))]


def missing_image_signal() -> list[Rule]:
    """Paragraphs that announce an image where none is or follows."""
    follows = F.coalesce(F.col("next_tag").isin("img", "figure") | F.col("next_has_img") | F.array_contains("next_classes", "missing-image"), F.lit(False))
    found = _tag("p", "div") & ~F.array_contains("classes", "missing-image") & F.char_length("text").between(1, 300) & _any(F.col("text"), IMAGE_SIGNALS) & (count_inside("img") == 0) & ~follows
    return [Rule(found, "WARN", F.format_string('Text announces an image: "%s"', _cut(F.col("text"), 80)))]


def md_notation_in_text() -> list[Rule]:
    """Emphasis that runs into the text after it, which Markdown can't tell from plain asterisks."""
    found = _tag("strong", "b", "em", "i") & ~within("pre", "code") & F.col("after").rlike(r"^\S")
    return [Rule(found, "WARN", F.format_string('<%s> "%s" runs into "%s"', F.col("tag"), _cut(F.col("text"), 20), _cut(F.col("after"), 1)))]


def suspicious_code_content() -> list[Rule]:
    """Code blocks that hold escaped structural markup."""
    return [Rule(_tag("pre") & (count_inside("code") > 0) & F.col("outer_html").rlike(ENCODED_TAG), "WARN", F.lit("Code block holds escaped markup; dismiss if it is meant"))]


def _spacer() -> Column:
    thin = F.trim(attr("height")).isin("0", "1") & (F.trim(attr("alt")) == "")
    return _tag("img") & ~_tracks() & (F.lower(urls.filename(attr("src"))).contains("spacer") | thin)


def imgur_image() -> list[Rule]:
    """Images on and links to a host that some regions block, unless archived."""
    url = F.when(_tag("img"), attr("src")).otherwise(attr("href"))
    return [Rule(_tag("img", "a") & url.contains("imgur.com") & ~url.contains("web.archive.org"), "WARN", F.concat(F.lit("imgur address, use an archived one: "), _cut(url, 100)))]


def linenumber_table_code() -> list[Rule]:
    """Tables of a column of line numbers and a column of code."""
    return [Rule(F.col("numbered_code").isNotNull(), "WARN", F.format_string('Line-number table of code: "%s"', _cut(F.col("numbered_code"), 50)))]


def potential_code_block() -> list[Rule]:
    """Paragraphs with line breaks that look like code."""
    text = F.translate("whole_text", "\u00a0", " ")
    strong, weak = _any(text, STRONG_CODE), sum((text.rlike(p).cast("int") for p in WEAK_CODE), F.lit(0))
    in_article = _tag("div") & (F.coalesce(F.get("ancestors", F.lit(0)), F.lit("")) == "article")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    total = F.aggregate(lines, F.lit(0), lambda a, line: a + F.char_length(line))
    found = _tag("p", "div") & (count_inside("br") > 0) & (count_inside("pre") == 0) & ~within("pre", "code") & ~in_article & F.char_length("whole_text").between(20, 5000)
    return [Rule(found & (strong | (weak >= 2)) & (F.size(lines) >= 2) & (total <= 80 * F.size(lines)), "WARN", F.format_string('Text with line breaks looks like code: "%s"', _cut(F.trim(F.translate(text, "\n", " ")), 60)))]


def code_no_newlines() -> list[Rule]:
    """Code blocks whose lines are parted by br, or that lost their line ends."""
    pre, breaks = _tag("pre") & (attr("data-oneliner") != "true"), count_inside("br") >= 2
    lost = ~F.col("whole_text").contains("\n") & (F.char_length("whole_text") >= 40) & F.col("whole_text").rlike(LOST_LINES)
    return [
        Rule(pre & breaks, "WARN", F.lit("Code block uses br for line ends")),
        Rule(pre & ~breaks & lost, "WARN", F.format_string('Code block has one long line: "%s"', _cut(F.col("whole_text"), 60))),
    ]


def no_article() -> list[Rule]:
    """Pages without an article or body, or with an empty one."""
    return [Rule((F.col("node_id") == -1) | ((F.col("node_id") == 0) & (F.size("inside") == 0) & (F.col("own_text") == "")), "ERROR", F.lit("Page has no article or body, or an empty one"))]


def parse_error() -> list[Rule]:
    """Pages that can't be taken apart."""
    return [Rule(F.col("node_id") == -2, "ERROR", F.concat(F.lit("Page can't be parsed: "), _cut(F.col("text"), 100)))]


DETECTORS: dict[str, Callable[[], list[Rule]]] = {
    f.__name__: f
    for f in (
        data_placeholder, noscript_remnant, external_image, tracking_pixel, empty_embed, unreplaced_gist, wordpress_chrome, missing_image_signal, md_notation_in_text,
        suspicious_code_content, imgur_image, linenumber_table_code, potential_code_block, code_no_newlines, no_article, parse_error,
    )
}


def scan(nodes: DataFrame, names=tuple(DETECTORS)) -> DataFrame:
    """All issues of pages whose elements are nodes, in one pass: (key, node_id, type, level, detail, selector).

    All detectors are one array expression over an element, so pages are parsed once however many there are.
    """
    key = nodes.columns[0]
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(name).alias("type"), (F.lit(r.level) if isinstance(r.level, str) else r.level).alias("level"), r.detail.alias("detail")))
        for name in names for r in DETECTORS[name]()
    ]))
    return nodes.filter(~F.col("in_byline")).select(key, "node_id", "selector", F.inline(found)).select(key, "node_id", "type", "level", "detail", "selector")


def scan_all(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All issues of pages: of single elements, of a page's spacers together, and of images that files (path) lacks."""
    found = scan(nodes).unionByName(layout_spacers(nodes))
    return found if files is None else found.unionByName(missing_local_image(nodes, files))


def layout_spacers(nodes: DataFrame) -> DataFrame:
    """Images without content that hold space: one issue a page with their number, at the first one."""
    key = nodes.columns[0]
    found = nodes.filter(_spacer() & ~F.col("in_byline")).select(key, "node_id", "selector", attr("width").alias("width"), attr("height").alias("height"))
    one = found.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct("node_id", "selector", "width", "height"), "node_id").alias("f"))
    detail = F.format_string("%d layout spacer image(s), the first %sx%s", F.col("n"), F.col("f.width"), F.col("f.height"))
    return one.select(key, F.col("f.node_id").alias("node_id"), F.lit("layout_spacer_image").alias("type"), F.lit("WARN").alias("level"), detail.alias("detail"), F.col("f.selector").alias("selector"))


def missing_local_image(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Images under ../../assets/ of which files (column path) has none: an anti join on the path."""
    key = nodes.columns[0]
    refs = nodes.filter(_tag("img") & attr("src").startswith("../../assets/")).select(key, "node_id", "selector", F.replace(attr("src"), F.lit("../../"), F.lit("")).alias("path"))
    found = refs.join(files.select("path").distinct(), "path", "left_anti")
    return found.select(key, "node_id", F.lit("missing_local_image").alias("type"), F.lit("ERROR").alias("level"), F.concat(F.lit("Image file is missing: "), F.col("path")).alias("detail"), "selector")


def summary(issues: DataFrame) -> DataFrame:
    """How many issues of each type."""
    return issues.groupBy("type").agg(F.count("*").alias("n"))


def scan_assets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Per page, its image references (key, src, width, height) by where they lead: total, localised, broken, and
    the missing and external ones. Empty, inline and tracking references don't count."""
    key = refs.columns[0]
    used = refs.filter((F.col("src") != "") & ~F.col("src").startswith("data:") & ~urls.is_tracking_pixel(F.col("src"), F.col("width"), F.col("height")))
    used = used.withColumn("path", F.regexp_replace("src", r"^(\.\./)+|^/", "")).withColumn("outside", F.col("src").startswith("http"))
    held = used.join(files.select(F.col("path").alias("file")).distinct(), F.col("path") == F.col("file"), "left")
    return held.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("file").isNotNull() & ~F.col("outside")).alias("localised"), F.count_if(F.col("file").isNull() | F.col("outside")).alias("broken"),
        F.sort_array(F.collect_set(F.when(F.col("file").isNull() & ~F.col("outside"), F.col("src")))).alias("missing_local"), F.sort_array(F.collect_set(F.when(F.col("outside"), F.col("src")))).alias("external"),
    )
