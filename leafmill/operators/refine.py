"""Refinement rules of code fences: suggestions, matching by a banded join, and ordered replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import markdown, rewrite

SLIDE = 2
ALIKE = 0.85
RULE = "check string, fence_index int, fingerprint string, content_sample string, fix map<string,string>"


def suggest(fences: DataFrame) -> DataFrame:
    """(key, check, level, detail, fence_index) for fences with prose in them or without a language."""
    key = fences.columns[0]
    line = lambda x: F.trim(x)
    prose = F.size(F.filter(F.split("content", "\n"), lambda x: (F.char_length(line(x)) > 20) & line(x).rlike(r"^\p{Lu}") & F.contains(line(x), F.lit(" ")) & ~line(x).rlike(r"^(?://|\*|#|@|<|/\*)")))
    found = F.array_compact(F.array(
        markdown._issue(prose >= 2, "prose_in_code", "WARN", F.format_string("fence %d: %d lines of prose in code", F.col("idx"), prose)),
        markdown._issue(F.col("language") == "", "language_tag_missing", "WARN", F.format_string("fence %d: no language", F.col("idx"))),
    ))
    return fences.select(key, F.inline(found), F.col("idx").alias("fence_index"))


def fence_index(detail: Column) -> Column:
    """The number after the word fence in a detail, -1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(detail, r"fence\s+(\d+)", 1), F.lit("")).try_cast("int"), F.lit(-1))


# Texts by which a block's language is told, the first language that has one; drl needs all three of its own.
LANGUAGE_TEXTS = {
    "java": ("system.out", "public class", "import java"),
    "xml": ("<?xml", "<beans", "xmlns"),
    "sql": ("select ", "insert into", "create table"),
    "python": ("def ", "print("),
    "javascript": ("function ", "const ", "var ", "=>"),
    "bash": ("#!/bin/bash", "echo ", "export "),
}
DRL_TEXTS = ("rule ", "when", "then")


def infer_language(content: Column) -> Column:
    """A language by what a block has in it, text without a sign."""
    low = F.lower(content)
    has = lambda text: F.contains(low, F.lit(text))
    signs = {name: F.array_contains(F.array(*map(has, texts)), True) for name, texts in LANGUAGE_TEXTS.items()}
    signs["python"] = signs["python"] | (has("import ") & has(":"))
    signs["drl"] = has(DRL_TEXTS[0]) & has(DRL_TEXTS[1]) & has(DRL_TEXTS[2])
    return F.coalesce(*[F.when(sign, F.lit(name)) for name, sign in signs.items()], F.lit("text"))


def build_rules(suggestions: DataFrame, fences: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Rules (key, then RULE) for suggestions, of the accepted checks if given (column check): an equi-join with the
    fences on key and index. Suggestions without a fence go."""
    key = fences.columns[0]
    chosen = suggestions if accepted is None else suggestions.join(accepted.select("check").distinct(), "check", "left_semi")
    joined = chosen.filter("fence_index >= 0").join(fences.withColumnRenamed("idx", "fence_index"), [key, "fence_index"])
    fix = F.when(F.col("check") == "language_tag_missing", F.create_map(F.lit("language"), infer_language(F.col("content")))).otherwise(F.create_map(F.lit("action"), F.lit("extract")))
    return joined.select(key, "check", "fence_index", "fingerprint", F.col("sample").alias("content_sample"), fix.alias("fix"))


def match(rules: DataFrame, fences: DataFrame) -> DataFrame:
    """(key, check, fence_index, idx or null): the fence that each rule means.

    Of the fences at most SLIDE places away, one with the rule's fingerprint, else one alike enough; the nearest
    place first, later before earlier. A band join, equal on the key.
    """
    key = fences.columns[0]
    same = _near(rules.select(key, "check", "fence_index", "fingerprint"), fences.select(key, "idx", "fingerprint"), key, "inner").filter("fingerprint = print")
    exact = _nearest(same, key)
    # texts are prepared and compared for the rules alone that no fingerprint answers, once a text and not once a pair
    found = exact.select(F.col(key).alias("__key"), F.col("check").alias("__check"), F.col("fence_index").alias("__index"))
    answered = (F.col(key) == F.col("__key")) & F.col("check").eqNullSafe(F.col("__check")) & (F.col("fence_index") == F.col("__index"))
    left = rules.select(key, "check", "fence_index", "content_sample").join(found, answered, "left_anti").withColumn("sample", markdown.normalised(F.col("content_sample")))
    texts = fences.select(key, "idx", "content").join(left.select(key), key, "left_semi").withColumn("plain", markdown.normalised(F.col("content"))).drop("content")
    near = _near(left.drop("content_sample"), texts, key, "left")
    alike = markdown.similarity(F.substring("plain", F.lit(1), F.char_length("sample")), F.col("sample")) >= ALIKE
    close = near.select(key, "check", "fence_index", "off", F.when(alike, F.col("idx")).alias("idx"))
    return exact.unionByName(_nearest(close, key))


def _near(rules: DataFrame, fences: DataFrame, key: str, how: str) -> DataFrame:
    """Rules with the fences (key, idx, fingerprint, ...) at most SLIDE places away; off is how far after its rule one is."""
    other = fences.withColumnsRenamed({key: "__other", "fingerprint": "print"})
    band = (F.col(key) == F.col("__other")) & F.col("idx").between(F.col("fence_index") - SLIDE, F.col("fence_index") + SLIDE)
    return rules.join(other, band, how).withColumn("off", F.col("idx") - F.col("fence_index")).drop("__other")


def _nearest(found: DataFrame, key: str) -> DataFrame:
    """Of each rule's fences the one that fits and is nearest, later before earlier; null if none fits."""
    rank = F.struct(F.abs("off").alias("far"), (F.col("off") < 0).alias("before"))
    return found.groupBy(key, "check", "fence_index").agg(F.min_by("idx", F.when(F.col("idx").isNotNull(), rank)).alias("idx"))


def _replay(md: str, rules: list[dict]) -> tuple[str, list[str]]:
    conflicts = []
    for rule in sorted(rules, key=lambda r: (-r["fence_index"], r["check"])):
        fences = {f[0]: f for f in rewrite.fences(md)}
        near = [fences[k] for k in (rule["fence_index"] + d for d in (0, 1, -1, 2, -2)) if k in fences]
        norm = lambda t: " ".join((t or "").lower().split())
        sample = norm(rule["content_sample"])
        same = lambda f: _alike(norm(f[4])[: len(sample)], sample) >= ALIKE
        found = next((f for f in near if _print(f[4]) == rule["fingerprint"]), None) or next((f for f in near if same(f)), None)
        fix = dict(rule["fix"] or {})
        if found is None:
            conflicts.append(f"{rule['check']}@fence_{rule['fence_index']}")
        elif rule["check"] == "language_tag_missing" and fix.get("language"):
            md = rewrite.tag_fence(md, found[1], fix["language"])
        elif rule["check"] == "prose_in_code":
            md = rewrite.lift_prose(md, found[1], found[2], found[4])
    return md, conflicts


def _print(text: str) -> str:
    import hashlib

    return hashlib.sha256(" ".join(text.lower().split()).encode()).hexdigest()[:16]


def _alike(a: str, b: str) -> float:
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def replay(posts: DataFrame, rules: DataFrame, key: str = "slug", md: str = "md") -> DataFrame:
    """(key, md, conflicts): texts with their rules applied, from the last fence up so that earlier ones keep their
    places; rules whose fence is gone are conflicts. A text's rules travel with it in one row."""
    kind = posts.schema[key].dataType.simpleString()
    own = rules.groupBy(key).agg(F.collect_list(F.struct("check", "fence_index", "fingerprint", "content_sample", F.map_entries("fix").alias("fix"))).alias("rules"))

    def run(batches):
        for pdf in batches:
            out = []
            for k, text, found in zip(pdf[key], pdf["md"], pdf["rules"]):
                mine = [dict(r, fix={e["key"]: e["value"] for e in r["fix"]}) for r in (found if found is not None else [])]
                out.append((k, *(_replay(text, mine) if text is not None else (None, []))))
            yield pd.DataFrame(out, columns=[key, "md", "conflicts"])

    return posts.select(key, F.col(md).alias("md")).join(own, key, "left").mapInPandas(run, f"{key} {kind}, md string, conflicts array<string>")
