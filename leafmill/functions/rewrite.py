"""Rewrites of page trees: junk removal, metadata, enrichment, code repair and rendering as Markdown."""

from __future__ import annotations

import difflib
import html as _html
import json
import re
import xml.dom.minidom

from leafmill.functions.dom import Node, Text, article_root, numbered_code, parse
from leafmill.functions.markdown import KNOWN_LANGUAGES

# What is junk when a page is taken in, and when it is converted.
INGEST_JUNK = (
    "script", "style", "nav", "header", "footer", ".sidebar", "#comments", ".comments-area", ".author-box", ".author-description", ".author-info", ".sharedaddy",
    ".addtoany_share_save_container", "[class*=wpDiscuz]", "[class*=addtoany]", ".jp-relatedposts", ".post-navigation", ".wpdiscuz-form-container", ".entry-header", ".entry-meta", "noscript",
)
CONVERT_JUNK = (
    ".entry-header", "header", ".entry-meta", ".author-box", ".author-description", ".author-info", ".addtoany_share_save_container", ".addtoany_share_save", ".sharedaddy",
    "#comments", ".comments-area", ".jp-relatedposts", ".post-navigation", ".wpdiscuz-form-container", "script", "style", "noscript",
)
ARTICLE_PLACES = ("article", ".entry-content", ".post-content", "#content", "main", ".content", "[role=main]")
CHROME_HEADINGS = ("author", "related posts", "feedback", "share", "about")
# Names of a highlighter's languages, and signs of languages in their order.
BRUSHES = {"jscript": "javascript", "js": "javascript", "csharp": "csharp", "c#": "csharp", "c++": "cpp", "cplusplus": "cpp", "plain": "plaintext", "text": "plaintext", "shell": "bash", "sh": "bash", "drl": "drl"}
LANGUAGE_SIGNS = {
    "java": (r"\bpublic\s+class\b", r"\bpublic\s+static\s+void\s+main\b", r"\bimport\s+java\."),
    "xml": (r"<\?xml\s", "xmlns="), "html": (r"<!DOCTYPE\s+html", r"<html[\s>]"),
    "sql": (r"\bSELECT\b.+\bFROM\b", r"\bCREATE\s+TABLE\b", r"\bINSERT\s+INTO\b"),
    "python": (r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bprint\s*\("),
    "javascript": (r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=", "=>"),
    "bash": (r"^#!.*\bsh\b", r"\$\{?\w+\}?"), "drl": (r'\brule\s+"', r"\bwhen\b.*\bthen\b", r"\bend\b"),
}
DRL_SIGNS = (r'(?i)\brule\s*["| ]', r'(?i)\bquery\s+[\w"]', r"(?is)\bwhen\b.*\bthen\b", r"(?m)^\s*end\s*$", r"(?i)\bdrools\b", r"(?i)\binsert\b|\bretract\b|\bmodify\b|\bupdate\b")
META_TEXTS = (r"(?i)^by\s", "(?i)Post Comment", "(?i)View all posts", "mailto:", r"(?i)^\[?\s*Rules?\s*\]?\s*\[?\s*Article")
SHARE_SITES = "(?i)addtoany|linkedin|twitter|facebook|reddit|tumblr"
SHARE_URLS = r"(?i)twitter\.com/intent|facebook\.com/sharer|linkedin\.com/share|reddit\.com/submit|plus\.google\.com/share|t\.co/"
ENCODED_TAG = r"(?i)&lt;(?:table|div|p|span|ul|ol|tr|td|th)\b"


def fits(node: Node, simple: str) -> bool:
    """Whether a node fits a selector of one tag, class, id or attribute."""
    if simple[0] == ".":
        return simple[1:] in node.classes
    if simple[0] == "#":
        return node.attrs.get("id") == simple[1:]
    if simple[0] == "[":
        name, value = simple[1:-1].split("=")
        return value in node.attrs.get(name[:-1], "") if name.endswith("*") else node.attrs.get(name) == value
    return node.tag == simple


def drop_all(root: Node, *selectors: str) -> None:
    for node in root.walk():
        if any(fits(node, s) for s in selectors):
            node.drop()


# ---- taking pages in


def find_article(root: Node) -> Node | None:
    """The first place of an article with any text, else the body, else the page."""
    for place in ARTICLE_PLACES:
        node = next((n for n in root.walk() if fits(n, place)), None)
        if node is not None and node.text():
            return node
    return root.first("body") or (root if root.elements() else None)


def sanitise(article: Node) -> None:
    """Drop junk, event handlers, script addresses and styles that load something."""
    drop_all(article, *INGEST_JUNK)
    for node in [article, *article.walk()]:
        for name, value in list(node.attrs.items()):
            scripted = name in ("href", "src", "action", "formaction", "data") and re.match(r"\s*(javascript|vbscript):", value, re.I)
            if name.startswith("on") or scripted or (name == "style" and re.search(r"url\(\s*['\"]?https?:", value, re.I)):
                del node.attrs[name]


def _json_ld(root: Node) -> dict:
    for script in root.all("script"):
        if script.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(map(str, script.kids)))
            except ValueError:
                continue
            for item in data if isinstance(data, list) else [data, *(data.get("@graph", []) if isinstance(data, dict) else [])]:
                if isinstance(item, dict) and re.search("BlogPosting|Article|Post", str(item.get("@type", ""))):
                    return item
    return {}


def metadata(root: Node) -> dict:
    """title, date, author, categories, tags and site, each from structured data, else meta elements, else the page."""
    meta = {}
    for node in root.all("meta"):
        meta.setdefault((node.attrs.get("property") or node.attrs.get("name") or "").lower(), node.attrs.get("content", "").strip())
    ld = _json_ld(root)
    author = ld.get("author") or ""
    author = author[0] if isinstance(author, list) and author else author
    author = author.get("name", "") if isinstance(author, dict) else author
    heading, title, time = root.first("h1"), root.first("title"), next((t for t in root.all("time") if t.attrs.get("datetime")), None)
    plain = re.split(r" [-|—–] ", title.whole().strip())[0] if title else ""
    words = ld.get("keywords") or meta.get("keywords") or ""
    rel = lambda kind: [a.text() for a in root.all("a") if kind in a.attrs.get("rel", "").split()]
    date = str(ld.get("datePublished") or ld.get("dateCreated") or meta.get("article:published_time") or meta.get("date") or meta.get("pubdate") or (time.attrs["datetime"] if time else "")).strip()
    byline = next((n.text() for n in root.walk() if "author" in n.classes), "")
    return {
        "title": str(ld.get("headline") or ld.get("name") or meta.get("og:title") or (heading.text() if heading else "") or plain),
        "date": date[:10], "author": str(author or meta.get("author") or byline),
        "categories": [w.strip() for w in (words if isinstance(words, list) else str(words).split(",")) if w.strip()] or rel("category"), "tags": rel("tag"),
        "site": meta.get("og:site_name") or (title.whole().strip() if title else ""),
    }


def extract(markup: str | None) -> dict:
    """What a page holds as a post: its metadata, clean article, and how many images it has; error if nothing."""
    root = parse(markup)
    found = metadata(root)
    article = find_article(root)
    if article is None:
        return found | {"html": "", "asset_count": 0, "error": "No article found"}
    sanitise(article)
    images = [i for i in article.all("img") if i.attrs.get("src") and not i.attrs["src"].startswith("data:")]
    return found | {"html": article.outer(), "asset_count": len(images), "error": ""}


# ---- enrichment


def _figure(kind: str, *kids: Node) -> Node:
    figure = Node("figure", {"class": kind})
    for k in kids:
        figure.add(k)
    return figure


def _element(tag: str, attrs: dict[str, str] | None = None, *kids) -> Node:
    node = Node(tag, attrs)
    for k in kids:
        node.add(Text(k) if isinstance(k, str) else k)
    return node


def _outside(url: str, text: str) -> Node:
    return _element("a", {"href": url, "target": "_blank", "rel": "noopener"}, text)


def video_id(url: str) -> str | None:
    found = re.match(r"https?://(?:www\.)?(?:youtu\.be/|youtube(?:-nocookie)?\.com/(?:embed/|[^#]*[?&]v=))([^/?&#]+)", url or "", re.I)
    return found[1] if found else None


def line_breaks(node: Node) -> int:
    """Put line ends for br inside pre; how many pre elements changed."""
    changed = 0
    for pre in node.all("pre"):
        breaks = pre.all("br")
        for br in breaks:
            br.swap(Text("\n"))
        changed += bool(breaks)
    return changed


def code_classes(node: Node) -> int:
    """Put language-X classes for a highlighter's brushes; how many pre elements changed."""
    changed = 0
    for pre in node.all("pre"):
        found = re.search(r"\bbrush\s*:\s*(\w+)\b", pre.attrs.get("class", ""), re.I)
        if not found:
            continue
        token = found[1].lower()
        language = BRUSHES.get(token, token)
        kept = [c for c in re.sub(r"\bbrush\s*:\s*\S+", "", pre.attrs["class"], flags=re.I).split() if c.lower().rstrip(";") not in {token, *BRUSHES}]
        pre.attrs["class"] = " ".join([*kept, f"language-{language}"])
        code = pre.first("code")
        if code is not None:
            code.attrs["class"] = " ".join([*(c for c in code.classes if not c.startswith("language-")), f"language-{language}"])
        changed += 1
    return changed


def detect_language(text: str) -> str | None:
    """The first language of which the text has a sign."""
    return next((name for name, signs in LANGUAGE_SIGNS.items() if any(re.search(s, text, re.M | re.I) for s in signs)), None)


def label_code(node: Node) -> int:
    """Label code blocks without a language by their text; how many were."""
    changed = 0
    for pre in node.all("pre"):
        code = pre.first("code")
        if code is None or any(c.startswith("language-") for c in [*code.classes, *pre.classes]):
            continue
        language = detect_language(code.whole())
        if language:
            code.attrs["class"] = " ".join([*code.classes, f"language-{language}"])
            changed += 1
    return changed


def videos(node: Node, thumbs: dict[str, str] | None = None) -> int:
    changed = 0
    for frame in node.all("iframe"):
        video = video_id(frame.attrs.get("src", ""))
        if video:
            link = _outside(f"https://www.youtube.com/watch?v={video}", "")
            link.kids = []
            link.add(Node("img", {"src": (thumbs or {}).get(video, ""), "alt": "YouTube video", "style": "max-width:100%"}))
            link.add(_element("figcaption", None, "▶ Watch on YouTube"))
            frame.swap(_figure("video-embed", link))
            changed += 1
    return changed


def gists(node: Node, files: dict[str, list[tuple[str, str, str]]] | None = None) -> tuple[int, int]:
    """Inline gists of known files (name, language, content); how many were, and how many were not known."""
    done = failed = 0
    for script in node.all("script"):
        found = re.match(r"https?://(?:www\.)?gist\.github\.com/((?:[^/?#]+/)?([^/?#]+?))(?:\.js)?(?:[?#].*)?$", script.attrs.get("src", ""))
        if not found:
            continue
        url, known = f"https://gist.github.com/{found[1]}", (files or {}).get(found[2])
        if known:
            parts = []
            for name, language, content in known:
                code = _element("code", {"class": f"language-{(language or 'text').lower()}"}, content)
                parts += [_element("figcaption", None, _outside(url, f"View on GitHub Gist: {name}")), _element("pre", None, code)]
            script.swap(_figure("gist-embed", *parts))
            done += 1
        else:
            script.swap(_figure("gist-embed", _element("p", {"class": "archive-note"}, "The gist is not in the archive. ", _outside(url, "View it on GitHub"), ".")))
            failed += 1
    return done, failed


def embeds(node: Node) -> int:
    changed = 0
    for tag in node.all("iframe", "object", "embed"):
        source = tag.attrs.get("src") or tag.attrs.get("data") or ""
        note = _element("p", {"class": "archive-note"}, "This embed is not in the archive. Its source: ", _outside(source, source) if source else "unknown")
        tag.swap(_figure("live-embed", note))
        changed += 1
    return changed


def enrich(markup: str | None, files: dict | None = None, thumbs: dict | None = None) -> tuple[str, dict[str, int]]:
    """The page with embeds replaced and code repaired and labelled, and what was done. Idempotent."""
    root = parse(markup)
    article = root.first("article") or root.first("body") or root
    stats = {"pre_br_normalised": line_breaks(article), "code_classes_normalised": code_classes(article)}
    stats["youtube_replaced"] = videos(article, thumbs)
    stats["gists_replaced"], stats["gists_failed"] = gists(article, files)
    stats["code_fixed"] = int(fix_code(article))
    stats["languages_detected"] = label_code(article)
    stats["embeds_replaced"] = embeds(article)
    return root.inner(), stats


# ---- code repair


def is_drl(text: str) -> bool:
    return any(re.search(p, text) for p in DRL_SIGNS)


def reformat_drl(text: str) -> str:
    """A rule on one line, with a line for each keyword outside quotes. Short, broken or other text stays."""
    if "\n" in text.strip() or len(text.strip()) < 15 or not is_drl(text):
        return text
    parts = re.split(r'("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')', text)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"\s*\b(when|then|end)\b\s*", r"\n\1\n", parts[k])
        parts[k] = re.sub(r"(?<=\S)\s+(?=\b(?:rule|query|import|package|global|salience)\b)", "\n", parts[k])
        parts[k] = re.sub(r";\s*(?=\S)", ";\n", parts[k])
    lines = [line.strip() for line in "".join(parts).split("\n")]
    return "\n".join(line for line in lines if line)


def reformat_xml(text: str) -> str:
    """Well-formed XML on one line, with an indented line for each element; other text stays."""
    if "\n" in text.strip():
        return text
    try:
        pretty = xml.dom.minidom.parseString(text.strip()).toprettyxml(indent="  ")
    except Exception:  # expat and minidom raise several kinds
        return text
    body = pretty if text.lstrip().startswith("<?xml") else pretty.split("\n", 1)[1]
    return "\n".join(line for line in body.split("\n") if line.strip())


def _as_lines(node: Node) -> str:
    copy = parse(node.outer()).elements()[0]
    for br in copy.all("br"):
        br.swap(Text("\n"))
    return copy.whole().replace(" ", " ").strip()


def _mean_line(text: str) -> float:
    lines = text.split("\n")
    return sum(len(x.strip()) for x in lines) / len(lines)


def _code_block(text: str, language: str | None) -> Node:
    return _element("pre", None, _element("code", {"class": language} if language else None, text))


def numbered_block(table: Node) -> Node | None:
    """The code of a table of line numbers and code as a block, else null."""
    text = (numbered_code(table) or "").strip()
    if not text:
        return None
    code = table.all("td")[1].first("pre", "code")
    kind = next((c for n in [code, *(code.walk() if code is not None else [])] if n is not None for c in n.classes if c.startswith("language-")), None)
    return _code_block(text, kind)


def fix_code(root: Node) -> bool:
    """Break one-line rules and XML into lines, make code blocks of rules in paragraphs and of numbered tables."""
    changed = False
    for pre in root.all("pre"):
        code = pre.first("code")
        if code is None:
            continue
        text = _html.unescape(code.inner()) if code.elements() else code.whole()
        fixed = text
        if {"language-drl", "language-sql"} & set(code.classes):
            fixed = reformat_drl(code.whole())
            text = code.whole()
        elif {"language-xml", "language-typescript"} & set(code.classes):
            fixed = reformat_xml(text)
        if fixed != text:
            code.kids = [Text(fixed)]
            changed = True
    for node in root.all("p", "div"):
        outside = any(a.tag in ("pre", "code") for a in node.above()) or node.first("pre", "code") is not None
        if node.up is None or outside or (node.tag == "div" and node.up.tag == "article"):
            continue
        breaks, keyword = len(node.all("br")), any(s.text().lower() == "rule" and not s.elements() for s in node.all("span"))
        if breaks >= 3 or (breaks and keyword):
            text = _as_lines(node)
            if is_drl(text) and len(text) <= (2000 if keyword else 10**9) and _mean_line(text) <= 80:
                node.swap(_code_block(reformat_drl(text), "language-drl"))
                changed = True
    for table in root.all("table"):
        block = numbered_block(table) if table.up is not None else None
        if block is not None:
            table.swap(block)
            changed = True
    return changed


# ---- conversion


def _chrome_headings(article: Node) -> None:
    for h in article.all("h2", "h3"):
        if h.text().lower() in CHROME_HEADINGS:
            for node in h.up.elements()[[k is h for k in h.up.elements()].index(True) :]:
                node.drop()
            return


def _metadata_elements(article: Node) -> None:
    for node in article.all("p", "div", "span"):
        text = node.text()
        links = " ".join(a.attrs.get("href", "") for a in node.all("a"))
        both = f"{text} {links}"
        byline = bool(re.search(META_TEXTS[0], text)) and len(text) < 300
        if node.tag == "div" and len(text) > 120:
            gone = byline
        else:
            shared = re.search(SHARE_SITES, both) and (re.search(SHARE_URLS, links) or (len(text) < 50 and not links))
            gone = (len(text) < 500 and any(re.search(p, both) for p in META_TEXTS)) or bool(shared) or byline
        if gone:
            node.drop()


def _repeated_links(article: Node) -> None:
    seen: dict[str, int] = {}
    links = [a for a in article.all("a") if a.attrs.get("href")]
    for a in links:
        seen[a.attrs["href"]] = seen.get(a.attrs["href"], 0) + 1
    for a in links:
        if seen[a.attrs["href"]] >= 5 and a.up is not None:
            a.unwrap()


def _tables(article: Node) -> None:
    for inner in [t for t in article.all("table") if t.up.tag == "td"]:
        outer = next((a for a in inner.above() if a.tag == "table"), None)
        if outer is not None and outer.up is not None and outer.text() == inner.text():
            outer.swap(inner)
    for table in article.all("table"):
        rows = [r for r in table.all("tr") if next(a for a in r.above() if a.tag == "table") is table]
        if table.first("thead") is None and len(rows) >= 2:
            for cell in rows[0].elements():
                cell.tag = "th"
            head = Node("thead", up=table)
            rows[0].drop()
            head.add(rows[0])
            table.kids.insert(0, head)


def _empty_tags(article: Node) -> None:
    while True:
        gone = [n for n in article.all("p", "div", "span", "li", "td", "th", "tr") if not n.text() and n.first("img", "table") is None]
        if not gone:
            return
        for n in gone:
            n.drop()


def _local_paths(article: Node) -> None:
    for node in article.all("img", "a"):
        name = "src" if node.tag == "img" else "href"
        value = node.attrs.get(name, "")
        if node.tag == "img" and value.startswith("data:"):
            node.drop()
        elif value.startswith("../../assets/"):
            node.attrs[name] = "/legacy/" + value.replace("../../", "")


def _clean_for_markdown(article: Node, meta: dict) -> None:
    drop_all(article, *CONVERT_JUNK)
    for node in [article, *article.walk()]:
        node.kids = [k for k in node.kids if isinstance(k, Node) or not k.comment]
    line_breaks(article)
    for pre in article.all("pre"):
        code = pre.first("code")
        if code is not None and re.search(ENCODED_TAG, code.inner()):
            real = parse(re.sub(r"<img[^>]*spacer[^>]*>", "", code.whole()))
            pre.swap(*real.kids)
    for quote in article.all("blockquote"):
        if not quote.classes and quote.first("cite") is None:
            quote.unwrap()
    author = (meta.get("author") or "").strip().lower()
    for node in article.walk():
        kind, href = node.attrs.get("class", "").lower(), node.attrs.get("href", "")
        authors = node.tag == "a" and ("search_authors" in href or "/author/" in href) and node.first("img") is not None
        friend = node.tag == "a" and re.search("send_to_friend|sendtofriend", href, re.I)
        if "wpdiscuz" in kind or "addtoany" in kind or authors or friend or (author and node.tag == "img" and node.attrs.get("alt", "").strip().lower() == author):
            node.drop()
    _chrome_headings(article)
    for h in article.all("h1", "h2", "h3", "h4", "h5", "h6"):
        for a in h.all("a"):
            a.unwrap()
    title = (meta.get("title") or "").lower()
    if len(title) >= 12:
        for h in article.all("h3"):
            if h.text().lower().startswith(title[:12]):
                h.drop()
    _repeated_links(article)
    _metadata_elements(article)
    _local_paths(article)
    _tables(article)
    _empty_tags(article)


def code_language(code: Node) -> str:
    for c in code.classes:
        if c.startswith("language-"):
            name = c[9:]
            break
        if c.lower() in KNOWN_LANGUAGES:
            name = c.lower()
            break
    else:
        return ""
    return "java" if name == "sql" and re.search(r"public |class |void |import ", code.whole().lower()) else name


def fence(text: str, language: str) -> str:
    """A code block, fenced by more backticks than the text has in a run."""
    ticks = "`" * max(3, max(map(len, re.findall("`+", text)), default=0) + 1)
    return f"{ticks}{language}\n{text.strip(chr(10))}\n{ticks}"


def _inline(node: Node) -> str:
    out = []
    for k in node.kids:
        if not isinstance(k, Node):
            out.append("" if k.comment else re.sub(r"\s+", " ", k))
            continue
        inner = _inline(k) if k.tag not in ("img", "br") else ""
        if k.tag == "br":
            out.append("  \n")
        elif k.tag == "img":
            out.append(f"![{k.attrs.get('alt', '')}]({k.attrs.get('src', '')})")
        elif k.tag in ("strong", "b", "em", "i", "code", "del", "s") and inner.strip():
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}[k.tag]
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            out.append(f"{lead}{mark}{inner.strip()}{mark}{tail}")
        elif k.tag == "a" and k.attrs.get("href"):
            out.append(f"[{inner.strip()}]({k.attrs['href']})")
        elif k.tag not in ("script", "style"):
            out.append(inner)
    return "".join(out)


_FLOW = frozenset("address article aside blockquote body dd div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul html #root".split())


def _rows(table: Node) -> str:
    rows = [[_inline(c).replace("|", "\\|").replace("\n", " ").strip() for c in r.elements() if c.tag in ("td", "th")] for r in table.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * wide, *rows[1:]])


def _blocks(node: Node) -> list[str]:
    """The Markdown blocks of what is in a node, in order."""
    out: list[str] = []
    run = Node("#run")

    def flush():
        text = _inline(run).strip()
        if text:
            out.append(re.sub(r" *\n *", lambda m: m[0].rstrip(" ") if not m[0].startswith("  ") else "  \n", text))
        run.kids = []

    for k in node.kids:
        if not isinstance(k, Node) or (k.tag not in _FLOW and k.first(*_FLOW) is None):
            run.kids.append(k)
            continue
        flush()
        if k.tag[0] == "h" and k.tag[1:].isdigit():
            text = " ".join(_inline(k).split())
            if text:
                out.append(f"{'#' * int(k.tag[1:])} {text}")
        elif k.tag == "hr":
            out.append("---")
        elif k.tag == "pre":
            code = k.first("code")
            out.append(fence((code or k).whole().replace(" ", " "), code_language(code or k)))
        elif k.tag in ("ul", "ol"):
            items = []
            for i, item in enumerate((x for x in k.elements() if x.tag == "li"), 1):
                mark = f"{i}. " if k.tag == "ol" else "* "
                items.append(mark + "\n".join(_blocks(item)).replace("\n", "\n" + " " * len(mark)))
            out.append("\n".join(items))
        elif k.tag == "blockquote":
            out.append("\n".join(f"> {line}".rstrip() for line in "\n\n".join(_blocks(k)).split("\n")))
        elif k.tag == "table":
            out.append(_rows(k))
        elif k.tag == "a" and k.attrs.get("href"):
            out.append(f"[{' '.join(_blocks(k))}]({k.attrs['href']})")
        else:
            out += _blocks(k)
    flush()
    return [x for x in out if x]


def front_matter(meta: dict, site_suffix: str | None = None) -> str:
    """The lines of metadata before a post's text."""
    title = re.sub(rf"\s*[-–]\s*{re.escape(site_suffix)}\s*$", "", meta.get("title") or "") if site_suffix else meta.get("title") or ""
    title = title.strip().replace('"', '\\"')
    items = lambda name: "".join(f"\n  - {x.strip()}" for x in meta.get(name) or [] if x and x.strip()) or "[]"
    lines = ("layout: post", f'title: "{title}"', f"date: {(meta.get('date') or '')[:10]}", f"author: {meta.get('author') or ''}", f"categories: {items('categories')}", f"tags: {items('tags')}", f"original_url: {meta.get('original_url') or ''}")
    return "---\n" + "\n".join(lines) + "\n---\n\n"


def mark_missing_images(article: Node) -> int:
    """Put a note for each image that was lost: inline placeholders, addresses left in noscript, and paragraphs that
    announce an image where none is; how many."""
    changed = 0

    def note(text: str) -> Node:
        return _element("blockquote", {"class": "missing-image"}, _element("p", None, f"Missing image: {text}"))

    for node in article.all("img", "noscript"):
        if node.tag == "img" and node.attrs.get("src", "").startswith("data:"):
            node.swap(note(node.attrs.get("alt", "") or "no description"))
            changed += 1
        elif node.tag == "noscript" and (found := re.search(r"https?://[^\s\"'<>]+", node.outer())):
            node.swap(note(found[0]))
            changed += 1
    for node in article.all("p"):
        follow = node.next_element()
        shown = node.first("img") is not None or (follow is not None and (follow.tag in ("img", "figure") or follow.first("img") is not None or "missing-image" in follow.classes))
        if not shown and len(node.text()) <= 300 and re.search(r"(?i)(?:as shown|(?:see|view) (?:the )?(?:image|screenshot|figure|diagram|chart)) (?:below|above)", node.text()):
            node.swap(node, note("announced by the text"))
            changed += 1
    return changed


def to_markdown(markup: str | None, meta: dict, site_suffix: str | None = None, placeholders: bool = False) -> str | None:
    """A page as Markdown with front matter, before the last cleaning of its text; null without an article.

    placeholders: leave a note for each lost image.
    """
    article = article_root(parse(markup))
    if article is None:
        return None
    if placeholders:
        mark_missing_images(article)
    _clean_for_markdown(article, meta)
    return front_matter(meta, site_suffix) + "\n\n".join(_blocks(article)) + "\n"


def load_article(markup: str | None) -> Node | None:
    """The article as validators see it: without junk, chrome headings, bylines and send-to-friend links."""
    article = article_root(parse(markup))
    if article is None:
        return None
    drop_all(article, "script", "style", "noscript", *CONVERT_JUNK)
    _chrome_headings(article)
    for node in article.all("p", "div", "span"):
        text = node.text()
        if len(text) < 200 and re.match(r"(?i)by\s+[A-Z]", text):
            node.drop()
    for a in article.all("a"):
        if re.search("send_to_friend|sendtofriend", a.attrs.get("href", ""), re.I):
            up = a.up
            a.drop()
            if up is not None and up.up is not None and not up.text():
                up.drop()
    return article


# ---- code fences of Markdown

_FENCES = re.compile(r"^(```+)(\w*)\n(.*?)^\1[ \t]*$", re.M | re.S)


def fences(md: str | None) -> list[tuple[int, int, int, str, str]]:
    """(index, start, end, language, content) of the fenced blocks, in order."""
    return [(k, m.start(), m.end(), m[2], m[3]) for k, m in enumerate(_FENCES.finditer(md or ""))]


def tag_fence(md: str, start: int, language: str) -> str:
    """md with the language of the fence that opens at start."""
    ticks = re.match("`+", md[start:])[0]
    end = md.index("\n", start)
    return f"{md[:start]}{ticks}{language}{md[end:]}"


def is_prose(line: str) -> bool:
    text = line.strip()
    return len(text) > 20 and text[0].isupper() and " " in text and not text.startswith(("//", "*", "#", "@", "<", "/*"))


def lift_prose(md: str, start: int, end: int, content: str) -> str:
    """md with the prose lines of a fence moved before it; a fence of prose alone stays."""
    lines = content.split("\n")
    prose = [x for x in lines if is_prose(x)]
    code = [x for x in lines if not is_prose(x)]
    if not prose or not "".join(code).strip():
        return md
    opening = md[start : md.index("\n", start) + 1]
    block = opening + "\n".join(code) + re.match("`+", opening)[0]
    return md[:start] + "\n".join(x.strip() for x in prose) + "\n\n" + block + md[end:]


def diff(old: str | None, new: str | None, context: int = 3) -> str:
    """A unified diff of two texts by lines."""
    return "\n".join(difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), "old", "new", lineterm="", n=context))
