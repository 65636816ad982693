"""Checks of Markdown by itself and against its page, as expressions and equi-joins on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import markdown, rewrite
from leafmill.operators.nodes import map_rows, spread

FACTS = (
    "words int, pres int, headings array<string>, paragraphs array<string>, text string, codes array<string>, lists int, links int, tables int, table_starts array<string>, "
    "images int, quotes int, youtube int, languages array<string>, phrases array<string>, error string"
)


def check(posts: DataFrame, key: str = "slug", md: str = "md") -> DataFrame:
    """(key, check, level, detail): the issues that each text has by itself, at most one of a check."""
    found = F.array_compact(F.array(*markdown.checks(F.col(md)).values()))
    return posts.select(key, F.inline(found))


def facts(pages: DataFrame, key: str = "slug", html: str = "html") -> DataFrame:
    """What the cross checks need of each page, read off its cleaned article once."""
    kind = pages.schema[key].dataType.simpleString()
    names = [x.split(" ")[0] for x in FACTS.split(", ")]

    def of(page: str | None) -> dict:
        article = rewrite.load_article(page)
        if article is None:
            return {"error": "No article"}
        plain = article
        if article.first("pre", "code") is not None:
            plain = rewrite.load_article(page)
            rewrite.drop_all(plain, "pre", "code")
        links = {a.attrs["href"] for a in article.all("a") if a.attrs.get("href", "").startswith("http") and "linkurl=" not in a.attrs["href"]}
        phrases = []
        for p in article.all("p"):
            text = p.text()
            if 80 <= len(text) <= 600 and p.first("img", "code") is None:
                phrases.append(text.split(" ", 1)[-1][:35])
        codes = [pre.whole() for pre in article.all("pre")]
        tables = [t for t in article.all("table") if len(t.all("tr")) >= 2 and len(t.text()) > 20]
        return {
            "words": len(plain.text().split()), "pres": len(codes), "headings": [h.text() for h in article.all("h2", "h3")], "paragraphs": [p.text() for p in article.all("p")], "text": article.text(),
            "codes": codes, "lists": sum(len([i for i in x.elements() if i.tag == "li"]) > 1 for x in article.all("ul", "ol")), "links": len(links), "tables": len(tables),
            "table_starts": [" ".join(t.text().lower().split()[:4]) for t in tables], "images": len([i for i in article.all("img") if "avatar" not in i.attrs.get("class", "")]),
            "quotes": sum(len(q.text()) > 20 for q in article.all("blockquote")),
            "youtube": sum("youtube" in f.attrs.get("src", "") or "youtu.be" in f.attrs.get("src", "") for f in article.all("iframe")) + sum("youtube.com/watch" in a.attrs.get("href", "") for a in article.all("a")),
            "languages": sorted({c[9:] for n in article.all("code", "pre") for c in n.classes if c.startswith("language-")}), "phrases": phrases[:8], "error": None,
        }

    def read(k, page: str | None) -> list[tuple]:
        try:
            found = of(page)
        except Exception as wrong:  # an unreadable page is a result, not a failure
            found = {"error": str(wrong)[:200]}
        return [(k, *(found.get(n, [] if n in ("headings", "paragraphs", "codes", "table_starts", "languages", "phrases") else 0 if n not in ("text", "error") else None) for n in names))]

    return map_rows(spread(pages.select(key, html)), read, f"{key} {kind}, {FACTS}")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), r"[^\w\s]", " "), r"\s+", " "))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _start(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.lower(text)), r"\s+"), 1, n), " ")


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator, which the optimiser doesn't put into the expressions
    that use them, where each use, and in functions of arrays each element, would compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def _prepared(joined: DataFrame) -> DataFrame:
    """joined with what several cross checks need of a text (md) and of its page (text)."""
    parts = F.filter(F.split("body", "\n\n"), lambda p: F.char_length(F.trim(p)) > 80)
    last = F.try_element_at(F.filter("paragraphs", lambda p: F.char_length(p) > 30), F.lit(-1))
    sought = (F.size("codes") > 0) | (F.size("phrases") > 0)
    bodies = _once(joined, body=markdown.body(F.col("md")), last=last)
    bodies = _once(bodies, low=F.lower("body"), squeezed=F.when(sought, _squeezed(F.col("body"))), plain=_plain(F.col("body")), ending=F.substring(_plain(F.col("last")), 1, 40), parts=parts)
    ordered = _once(bodies, ordered=F.sort_array("parts"))
    twice = F.array_compact(F.zip_with("ordered", F.slice("ordered", 2, F.size("ordered")), lambda p, q: F.when(p == q, p)))
    repeated = _once(ordered, repeated=F.array_intersect("parts", twice))
    return _once(repeated, page=F.when(F.size("repeated") > 0, _squeezed(F.col("text"))))


def cross_checks(md: Column, terms=(), extended: bool = True) -> dict[str, Column]:
    """For each check of a text against the facts of its page (columns of facts() and _prepared()), its issue or null.

    terms: words of the trade that must survive conversion. The first five always apply, the rest if extended.
    """
    issue = markdown._issue
    text, low, squeezed = F.col("body"), F.col("low"), F.col("squeezed")
    md_words, fences = markdown.words(markdown.without_fences(text)), F.floor(markdown.fence_lines(md) / 2).cast("int")
    lost_heads = F.filter("headings", lambda h: (F.char_length(h) >= 3) & ~F.contains(low, _start(h, 4)))
    last, ending = F.col("last"), F.col("ending")
    lost_terms = F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(F.lower("text"), t) & ~F.contains(F.lower(md), t))
    out = {
        "word_count": issue((F.col("words") > 150) & (md_words < F.col("words") * 0.35), "word_count", "WARN", F.format_string("Text has %d words, page %d", md_words, F.col("words"))),
        "code_block_count": F.coalesce(
            issue((F.col("pres") > 0) & (fences == 0), "code_block_count", "ERROR", F.format_string("All %d code blocks are gone", F.col("pres"))),
            issue((F.col("pres") > 0) & (F.abs(F.col("pres") - fences) > 1), "code_block_count", "WARN", F.format_string("Page has %d code blocks, text %d", F.col("pres"), fences)),
        ),
        "heading_match": issue(F.size(lost_heads) > 0, "heading_match", "WARN", F.concat(F.lit("Headings are gone: "), F.array_join(F.slice(lost_heads, 1, 3), "; "))),
        "last_section_present": issue((ending != "") & ~F.contains("plain", ending), "last_section_present", "WARN", F.concat(F.lit("The last paragraph is gone: "), F.substring(last, 1, 60))),
        "technical_terms": issue(F.size(lost_terms) > 0, "technical_terms", "WARN", F.concat(F.lit("Terms are gone: "), F.array_join(lost_terms, ", "))),
    }
    if not extended:
        return out
    page = F.col("page")
    doubled = F.filter("repeated", lambda p: (F.char_length(page) - F.char_length(F.replace(page, F.substring(_squeezed(p), 1, 30), F.lit("")))) < 2 * F.least(F.lit(30), F.char_length(_squeezed(p))))
    body_has = lambda piece: F.contains(squeezed, _squeezed(piece))
    lost_code = F.filter("codes", lambda c: (F.char_length(_squeezed(c)) >= 10) & ~body_has(F.substring(F.trim(c), 1, 25)))
    cut_code = F.filter("codes", lambda c: (F.char_length(F.trim(c)) >= 60) & body_has(F.substring(F.trim(c), 1, 25)) & ~body_has(F.substring(F.trim(c), -30, 30)))
    lost_phrases = F.filter("phrases", lambda p: ~body_has(p))
    n_links = F.size(F.array_distinct(F.regexp_extract_all(md, F.lit(r"\]\(<?(https?://[^)\s>]+)"), 1)))
    md_youtube = F.regexp_count(md, F.lit(r"youtube\.com/watch|youtu\.be/"))
    out |= {
        "duplicate_paragraph": issue(F.size(doubled) > 0, "duplicate_paragraph", "ERROR", F.concat(F.lit("A paragraph is there twice: "), F.substring(F.get(doubled, F.lit(0)), 1, 60))),
        "code_content_missing": issue(F.size(lost_code) > 0, "code_content_missing", "ERROR", F.concat(F.lit("Code is gone: "), F.substring(F.trim(F.get(lost_code, F.lit(0))), 1, 40))),
        "code_content_truncated": issue(F.size(cut_code) > 0, "code_content_truncated", "WARN", F.concat(F.lit("Code is cut: "), F.substring(F.trim(F.get(cut_code, F.lit(0))), 1, 40))),
        "lists_dropped": issue((F.col("lists") > 0) & ~text.rlike(r"(?m)^\s*(?:[*+-]|\d+\.)\s"), "lists_dropped", "WARN", F.format_string("%d lists are gone", F.col("lists"))),
        "links_dropped": issue((F.col("links") > 5) & (n_links < F.col("links") * 0.3), "links_dropped", "WARN", F.format_string("Page has %d links, text %d", F.col("links"), n_links)),
        "table_dropped": issue((F.col("tables") > 0) & ~text.rlike(r"(?m)^\s*\|") & ~F.exists("table_starts", lambda t: F.contains(low, t)), "table_dropped", "WARN", F.format_string("%d tables are gone", F.col("tables"))),
        "images_dropped": issue((F.col("images") > 3) & (F.regexp_count(md, F.lit(r"!\[")) == 0), "images_dropped", "WARN", F.format_string("All %d images are gone", F.col("images"))),
        "blockquotes_dropped": issue((F.col("quotes") > 0) & ~text.rlike("(?m)^>"), "blockquotes_dropped", "WARN", F.format_string("%d quotes are gone", F.col("quotes"))),
        "content_phrase_missing": issue(F.size(lost_phrases) > 0, "content_phrase_missing", "WARN", F.concat(F.lit("Text is gone: "), F.array_join(F.slice(lost_phrases, 1, 2), "; "))),
        "chrome_leakage": issue(F.contains(low, F.lit("leave a reply")) | F.contains(low, F.lit("you might also like")) | F.contains(low, F.lit("share this:")), "chrome_leakage", "WARN", "Chrome of the blog is in the text"),
        "youtube_count": issue((F.col("youtube") > 0) & (md_youtube < F.col("youtube")), "youtube_count", "WARN", F.format_string("Page has %d videos, text %d", F.col("youtube"), md_youtube)),
        "html_languages_missing": issue(F.size(F.array_except("languages", markdown.languages(md))) > 0, "html_languages_missing", "WARN", F.concat(F.lit("Languages are gone: "), F.array_join(F.array_except("languages", markdown.languages(md)), ", "))),
    }
    return out


def cross_check(posts: DataFrame, pages: DataFrame, key: str = "slug", md: str = "md", html: str = "html", terms=(), extended: bool = True) -> DataFrame:
    """(key, check, level, detail) of texts with a page: an inner join on the key. An unreadable page is an issue."""
    joined = _prepared(posts.select(key, F.col(md).alias("md")).join(facts(pages, key, html), key))
    broken = markdown._issue(F.col("error").isNotNull(), "cross_check_error", "WARN", F.concat(F.lit("The page can't be read: "), F.col("error")))
    found = F.array_compact(F.array(broken, *[F.when(F.col("error").isNull(), c) for c in cross_checks(F.col("md"), terms, extended).values()]))
    return joined.select(key, F.inline(found))


def validate(posts: DataFrame, pages: DataFrame | None = None, **options) -> DataFrame:
    """All issues of texts, by themselves and, where pages are given, against them."""
    alone = check(posts, options.get("key", "slug"), options.get("md", "md"))
    return alone.unionByName(cross_check(posts, pages, **options)) if pages is not None else alone


def totals(issues: DataFrame) -> DataFrame:
    """How many issues of each level."""
    return issues.groupBy("level").agg(F.count("*").alias("n"))
