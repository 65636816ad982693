"""URL filters: longest rule, else trust and distrust propagated over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Table

#: (rule, verdict): host and path, longest rule first wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
DAMPING = 0.85
TOLERANCE = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does. Rules are a short list in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        at, start = text.partition("/")[0], text[len(text.partition("/")[0]) :]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst): each pair of different hosts of which a page of one links to the other, once."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINKS), 1), lambda x: F.translate(x, UPPER, LOWER)))
    return pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("src <> dst AND src <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) over edges (src, dst) from seeds (host, good, bad).

    Trust is a personalised PageRank: a host passes the damped share of its trust on to the hosts that it links to,
    in equal parts, and seeds keep getting the rest; distrust goes the other way, from a host to those that link to
    it. What a host without links would pass on is lost. Ends when the ranks move by less than TOLERANCE of the number of
    seeds in all and no host was reached anew. Only sums reach the driver; each step's ranks are a table, so lineage
    stays short.
    """
    out_n = edges.groupBy("src").agg(F.count("*").alias("outs")).withColumnRenamed("src", "o")
    in_n = edges.groupBy("dst").agg(F.count("*").alias("ins")).withColumnRenamed("dst", "i")
    links = Table(edges.join(out_n, F.col("src") == F.col("o")).join(in_n, F.col("dst") == F.col("i")).select("src", "dst", "outs", "ins"), "host-links").df
    base = Table(seeds.select("host", F.col("good").cast("double").alias("good"), F.col("bad").cast("double").alias("bad")), "host-seeds").df
    start = [((1 - damping) * F.col(c)).alias(n) for c, n in (("good", "trust"), ("bad", "distrust"))]
    ranks, reached = base.select("host", *start), -1
    mass = base.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0.0
    while True:
        given = (
            links.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (damping * F.col("trust") / F.col("outs")).alias("trust"), F.lit(0.0).alias("distrust"))
            .unionByName(links.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") / F.col("ins")).alias("distrust")))
            .unionByName(base.select("host", *start))
        )
        new = given.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        old = ranks.select(F.col("host").alias("was"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        delta = F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))
        step = Table(new.join(old, F.col("host") == F.col("was"), "left").select("host", "trust", "distrust", delta.alias("delta")), "host-ranks").df
        ranks, before = step.select("host", "trust", "distrust"), reached
        # Shares of a rank reach their hosts over either kind of link; each kind is counted, as one may come later.
        moved, *sides = step.agg(F.sum("delta"), F.count_if(F.col("trust") > 0), F.count_if(F.col("distrust") > 0)).first()
        reached = sum(sides)
        if (moved or 0.0) <= TOLERANCE * mass and reached == before:
            return ranks


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with columns host, path, rule and verdict, which replace any of these names.

    Where no rule fits a page, its host is judged: seeds are the hosts of which rules allow (block) more than half
    of all pages; a host is blocked if more distrust than trust reaches it. A host that neither reaches is allowed,
    and so are null URLs and those without "://". Repeated rows are judged alike; an empty table gives none.
    """
    at, way = host(F.col(url_col)), path(F.col(url_col))
    rule, says = match(F.col("host"), F.col("path"), rules)
    named = pages.drop("rule", "verdict").withColumns({"host": at, "path": way}).withColumns({"rule": rule, "__says": says})
    tally = named.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("__says") == "allow").alias("ok"), F.count_if(F.col("__says") == "block").alias("no"))
    seeds = tally.filter("host <> '' AND 2 * greatest(ok, no) > n").select("host", (F.col("ok") > F.col("no")).cast("int").alias("good"), (F.col("no") > F.col("ok")).cast("int").alias("bad"))
    ranks = propagate(host_edges(named, html_col), seeds).select(F.col("host").alias("__host"), (F.col("distrust") > F.col("trust")).alias("__bad"))
    joined = named.join(ranks, F.col("host") == F.col("__host"), "left")
    verdict = F.coalesce("__says", F.when(F.col("__bad"), "block").otherwise("allow"))
    return joined.withColumn("verdict", verdict).drop("__says", "__host", "__bad")


JUDGE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(rule, place, start, says) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), ruled AS (
  SELECT n.*, (SELECT max(struct_pack(size := length(rule), rule := rule, says := says)) FROM rules
               WHERE (n.host = place OR ends_with(n.host, '.' || place)) AND starts_with(n.path, start)) AS r FROM named n
), seeds AS (
  SELECT host, (count_if(r.says = 'allow') > count_if(r.says = 'block'))::INT AS good, (count_if(r.says = 'block') > count_if(r.says = 'allow'))::INT AS bad
  FROM ruled WHERE host <> '' GROUP BY host HAVING 2 * greatest(count_if(r.says = 'allow'), count_if(r.says = 'block')) > count(*)
), edges AS (
  SELECT DISTINCT host AS src, dst FROM (SELECT host, translate(unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM named)
  WHERE host <> dst AND host <> ''
), flow(a, b, t, d) AS (
  SELECT src, dst, 0.85 / count(*) OVER (PARTITION BY src), 0 FROM edges UNION ALL SELECT dst, src, 0, 0.85 / count(*) OVER (PARTITION BY dst) FROM edges
  UNION ALL SELECT '#', host, 0.15 * good, 0.15 * bad FROM seeds UNION ALL SELECT '#', '#', 1, 1
), ranks(step, host, t, d) AS (
  SELECT 0, '#', 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, b, sum(ranks.t * flow.t)::DOUBLE, sum(ranks.d * flow.d)::DOUBLE FROM ranks JOIN flow ON a = host WHERE step < 100 GROUP BY step, b
)
SELECT page_id, n.host, path, r.rule AS rule, coalesce(r.says, CASE WHEN k.d > k.t THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled n LEFT JOIN (SELECT host, t, d FROM ranks WHERE step = 100) k ON n.host = k.host
"""
