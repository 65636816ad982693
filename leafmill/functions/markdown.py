"""Markdown functions and checks over one column of text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language tags of code fences.
KNOWN_LANGUAGES = (
    "java", "python", "javascript", "js", "typescript", "ts", "xml", "json", "yaml", "yml", "sql", "bash", "sh", "shell", "groovy", "kotlin", "scala", "go", "rust", "c", "cpp",
    "html", "css", "properties", "text", "plain", "diff", "drools", "drl", "console", "log", "dockerfile",
)
# Left-overs of a blog's chrome.
JUNK_TEXTS = ("(?i)View all posts", "(?i)Post Comment", "(?i)addtoany", "(?i)wpDiscuz")
# Lines that conversion leaves and nobody wants.
JUNK_LINES = (r"^\[\]\(<?https?://[^)]*\)\s*$", r"^\[Post Comment\]", r"^## Author\s*$", r"^\* !\[.*?\]\(/legacy/assets/images.*?\)\s*$", r"^\[ View all posts \]", r"^\[ \]\(<mailto:")
ENTITY = "&amp;|&lt;|&gt;|&quot;|&nbsp;"
PLACEHOLDER = r"@@CODEBLOCK_\d+@@|CODEBLOCK_FENCE_\d+"


def body(md: Column) -> Column:
    """What follows the front matter, or everything."""
    at = F.instr(md, "\n---\n")
    return F.when(at > 0, F.substring(md, at + 5, F.char_length(md))).otherwise(md)


def front_matter(md: Column) -> Column:
    """The lines between the first --- and the next, else null."""
    found = F.regexp_extract(md, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.when(md.rlike(r"(?s)\A---\n.*?\n---\n"), found)


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)`{3,}[^\n]*\n.*?`{3,}", "")


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def fence_lines(md: Column) -> Column:
    return F.regexp_count(md, F.lit(r"(?m)^`{3,}"))


def unbalanced(md: Column) -> Column:
    """Whether a fence stays open: one closes with a line of at least as many backticks and nothing else."""
    step = lambda open_, line: F.when(
        line == 0, open_
    ).when(open_ == 0, F.abs(line)).when((line > 0) & (line >= open_), F.lit(0)).otherwise(open_)
    # a line counts its backticks, below 0 if an info string follows, 0 if they are fewer than three
    ticks = lambda line: F.char_length(F.regexp_extract(F.trim(line), "^(`{3,})", 1)) * F.when(F.trim(line).rlike(r"^`+\s*$"), 1).otherwise(-1)
    return F.aggregate(F.transform(F.split(body(md), "\n"), ticks), F.lit(0), step) > 0


def languages(md: Column) -> Column:
    """The language tags of fences, in lower case and in order."""
    return F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^`{3,}(\w+)"), 1), F.lower)


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the hash of the text in lower case with single spaces."""
    return F.substring(F.sha2(normalised(text), 256), 1, 16)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """The share of places with the same character, of the longer text; two empty ones are alike."""
    n, m = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(m == 0, F.lit(1.0)).otherwise(F.when(n == 0, 0).otherwise(same) / m)


_FENCED = r"(?ms)^(`{3,})[^`\n]*\n(?:.*?\n)?\1`*[ \t]*$"


def clean(md: Column) -> Column:
    """Converted Markdown without junk lines and empty links, with # headings, rules and at most one blank line; code in
    fences stays as it is."""
    prose, code = F.split(md, _FENCED, -1), F.regexp_extract_all(md, F.lit(_FENCED), 0)
    parts = F.zip_with(F.transform(prose, _clean_prose), code, lambda text, block: F.concat(text, F.coalesce(block, F.lit(""))))
    return F.regexp_replace(F.array_join(parts, ""), r"\A\s+|\s+\z", "")


# Headings underlined with = and -, rules of =, and blank lines inside tables, with what replaces them.
PROSE_PATTERNS = ((r"(?m)^(\S[^\n]*)\n=+$", "# $1"), (r"(?m)^([^-\n][^\n]*)\n-+$", "## $1"), (r"(?m)^={4,}\s*$", "\n---"), (r"(?m)^(\|.*)\n(?:[ \t]*\n)+(?=\|)", "$1\n"), ("\n{3,}", "\n\n"))


def _clean_prose(text: Column) -> Column:
    plain = F.regexp_replace(text, r"\[\]\(<?https?://[^)]*\)", "")
    text = F.array_join(F.filter(F.split(plain, "\n"), lambda line: ~_any(line, JUNK_LINES)), "\n")
    for pattern, new in PROSE_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return text


def _any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def _issue(when: Column, check: str, level: str, detail: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def _front_matter_issue(md: Column) -> Column:
    head = front_matter(md)
    lost = F.filter(F.array(*[F.when(~head.contains(f"{f}:"), F.lit(f)) for f in ("title", "date", "author")]), lambda x: x.isNotNull())
    name = "front_matter_invalid"
    return F.coalesce(
        _issue(~md.startswith("---\n"), name, "ERROR", "No front matter"), _issue(head.isNull() & md.isNotNull(), name, "ERROR", "Front matter is not closed"),
        _issue(F.size(lost) > 0, name, "ERROR", F.concat(F.lit("Fields are missing: "), F.array_join(lost, ", "))),
        _issue(~head.rlike(r"(?m)^date:\s*\d{4}-\d{2}-\d{2}"), name, "WARN", "The date is not YYYY-MM-DD"),
    )


def checks(md: Column) -> dict[str, Column]:
    """For each check of a text by itself, its issue (check, level, detail) or null."""
    text, count = body(md), lambda t, p: F.regexp_count(t, F.lit(p))
    stripped = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    longest = F.array_max(F.transform(F.split(md, "\n"), F.char_length))
    unknown = F.filter(languages(md), lambda x: ~x.isin(*KNOWN_LANGUAGES))
    orphans = F.regexp_extract_all(md, F.lit(PLACEHOLDER), 0)
    return {
        "orphaned_placeholder": _issue(F.size(orphans) > 0, "orphaned_placeholder", "ERROR", F.concat(F.lit("Placeholders are left: "), F.array_join(F.slice(orphans, 1, 3), ", "))),
        "stray_digit_after_fence": _issue(md.rlike(r"(?m)^`{3,}\d"), "stray_digit_after_fence", "ERROR", "A digit follows a fence"),
        "unbalanced_fences": _issue(unbalanced(md), "unbalanced_fences", "ERROR", "A code fence stays open"),
        "empty_code_block": _issue(md.rlike(r"(?m)^`{3,}[^\n]*\n`{3,}"), "empty_code_block", "WARN", "A code block is empty"),
        "front_matter_invalid": _front_matter_issue(md),
        "empty_body": _issue(F.char_length(stripped) < 20, "empty_body", "ERROR", F.format_string("The body has %d characters", F.char_length(stripped))),
        "wordpress_junk": _issue(_any(text, JUNK_TEXTS), "wordpress_junk", "WARN", "Chrome of the blog is left"),
        "html_entities_in_body": _issue(count(text, ENTITY) >= 5, "html_entities_in_body", "WARN", F.format_string("%d HTML entities in the body", count(text, ENTITY))),
        "local_image_paths": _issue(md.contains("../../assets/"), "local_image_paths", "ERROR", "A relative asset path is left"),
        "broken_md_links": _issue(md.rlike(r"\[[^\]]+\]\(\)"), "broken_md_links", "WARN", "A link has no address"),
        "no_triple_blanks": _issue(md.rlike("\n{4,}"), "no_triple_blanks", "WARN", "Three blank lines or more"),
        "excessive_line_length": _issue(longest > 8000, "excessive_line_length", "WARN", F.format_string("A line has %d characters", longest)),
        "many_missing_images": _issue(count(md, "MISSING_IMAGE|missing-image-placeholder") > 10, "many_missing_images", "WARN", F.format_string("%d images are missing", count(md, "MISSING_IMAGE|missing-image-placeholder"))),
        "code_fence_language": _issue(F.size(unknown) > 0, "code_fence_language", "WARN", F.concat(F.lit("Unknown languages: "), F.array_join(F.slice(unknown, 1, 3), ", "))),
    }
