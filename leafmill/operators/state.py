"""The state of posts: one row per slug, changed by joins that make new snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "slug string, title string, date string, author string, original_url string, ingested_at timestamp, html struct<hash:string,issues:array<struct<type:string,level:string,detail:string,selector:string>>,checked_at:timestamp>, "
    "assets struct<total:int,localised:int,broken:int,checked_at:timestamp>, md struct<generated_at:timestamp,html_hash:string,issues:array<struct<check:string,level:string,detail:string>>,staged:boolean,staged_at:timestamp,validated_at:timestamp,suggestions:array<struct<check:string,level:string,detail:string,fence_index:int>>,suggestions_at:timestamp>, "
    "enriched struct<generated_at:timestamp,youtube_replaced:int,gists_replaced:int,gists_failed:int,classes_normalised:int,languages_detected:int,embeds_wrapped:int>, "
    "refinement struct<accepted:array<struct<check:string,fence_index:int,fingerprint:string,content_sample:string,fix:map<string,string>>>,replay_conflicts:array<string>,refined_at:timestamp>, flagged boolean, user_note string, reviewed boolean"
)
MERGED = ("html", "md", "assets", "refinement", "enriched")
PATCHABLE = ("flagged", "reviewed", "user_note")


def short_hash(content: Column) -> Column:
    """The first 12 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def stale(generated_at: Column, html_hash: Column, md_hash: Column) -> Column:
    """Whether Markdown was made of another page than there is now; unknown hashes are not stale."""
    there = lambda c: c.isNotNull() & (c.cast("string") != "")
    return F.coalesce(there(generated_at) & there(html_hash) & there(md_hash) & (html_hash != md_hash), F.lit(False))


def with_stale(state: DataFrame) -> DataFrame:
    return state.withColumn("stale", stale(F.col("md.generated_at"), F.col("html.hash"), F.col("md.html_hash")))


def merge(state: DataFrame, patch: DataFrame, clear: Sequence[str] = ()) -> DataFrame:
    """state with the non-null fields of patch (by slug): whole columns, and field by field inside the structs of
    MERGED. New slugs are added. Fields named in clear (column, or struct.field) become null for the slugs of patch where
    patch has no value. The last of several patches of a slug must be chosen before."""
    p = patch.select(F.col("slug").alias("__slug"), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != "slug"])
    joined = state.join(p, F.col("slug") == F.col("__slug"), "full_outer")
    kept = lambda name: F.when(F.col("__slug").isNull(), F.col(name)) if name in clear else F.col(name)
    out = [F.coalesce("slug", "__slug").alias("slug")]
    for c in state.columns:
        if c == "slug":
            continue
        given = [n for n in patch.schema[c].dataType.names] if c in patch.columns and c in MERGED else []
        if c in MERGED and (given or any(x.startswith(f"{c}.") for x in clear)):
            fields = [(F.coalesce(F.col(f"__{c}.{n}"), kept(f"{c}.{n}")) if n in given else kept(f"{c}.{n}")).alias(n) for n in state.schema[c].dataType.names]
            there = F.col(c).isNotNull() | F.col(f"__{c}").isNotNull() if given else F.col(c).isNotNull()
            out.append(F.when(there, F.struct(*fields)).alias(c))
        else:
            out.append((F.coalesce(F.col(f"__{c}"), kept(c)) if c in patch.columns else kept(c)).alias(c))
    return joined.select(*out)


def patch(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state with the changes that a user may make; other columns of changes are ignored."""
    return merge(state, changes.select("slug", *[c for c in changes.columns if c in PATCHABLE]))


def active_issues(issues: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Issues (slug, type, ...) of types that were not dismissed: an anti join."""
    return issues.join(dismissals.select("slug", "type").distinct(), ["slug", "type"], "left_anti")


def kept_dismissals(dismissals: DataFrame, issues: DataFrame) -> DataFrame:
    """Dismissals whose type was found again: a semi join. The others are cleared."""
    return dismissals.join(issues.select("slug", "type").distinct(), ["slug", "type"], "left_semi")


def dismiss(dismissals: DataFrame, chosen: DataFrame, state: DataFrame) -> DataFrame:
    """dismissals with those chosen (slug, type, ts) of known slugs; a type dismissed again keeps its first time."""
    both = dismissals.unionByName(chosen.join(state.select("slug"), "slug", "left_semi").select(dismissals.columns))
    return both.groupBy("slug", "type").agg(F.min("ts").alias("ts"))


def undismiss(dismissals: DataFrame, chosen: DataFrame) -> DataFrame:
    return dismissals.join(chosen.select("slug", "type").distinct(), ["slug", "type"], "left_anti")


def set_html_issues(state: DataFrame, issues: DataFrame, dismissals: DataFrame, hashes: DataFrame, as_of: Column) -> DataFrame:
    """state after a scan: the active issues of every scanned slug (hashes: slug, hash), its hash and the time."""
    live = active_issues(issues, dismissals).groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("type", "level", "detail", "selector"))).alias("issues"))
    kind = state.schema["html"].dataType["issues"].dataType
    scanned = hashes.join(live, "slug", "left").select("slug", F.struct(F.col("hash"), F.coalesce("issues", F.array().cast(kind)).alias("issues"), as_of.alias("checked_at")).alias("html"))
    return merge(state, scanned)


def mark_generated(state: DataFrame, made: DataFrame, as_of: Column) -> DataFrame:
    """state after conversion of slugs (slug, html): both hashes are the page's; staging, validation and issues of the
    version before are gone."""
    kind = state.schema["md"].dataType["issues"].dataType
    new = made.select(
        "slug", F.struct(short_hash(F.col("html")).alias("hash")).alias("html"),
        F.struct(as_of.alias("generated_at"), short_hash(F.col("html")).alias("html_hash"), F.array().cast(kind).alias("issues"), F.lit(False).alias("staged")).alias("md"),
    )
    return merge(state, new, clear=("md.staged_at", "md.validated_at"))


def _listed(state: DataFrame, found: DataFrame, checked: DataFrame, column: str) -> DataFrame:
    """(slug, items) of checked slugs: the rows of found in the form of the state's md column, none for a clean slug."""
    kind = state.schema["md"].dataType[column].dataType
    own = found.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct(*kind.elementType.names))).alias("items"))
    return checked.select("slug").distinct().join(own, "slug", "left").select("slug", F.coalesce("items", F.array()).cast(kind).alias("items"))


def set_md_issues(state: DataFrame, issues: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    """state after a check of texts (checked: slug): their issues (slug, check, level, detail) in place of those before."""
    return merge(state, _listed(state, issues, checked, "issues").select("slug", F.struct(F.col("items").alias("issues"), as_of.alias("validated_at")).alias("md")))


def set_md_suggestions(state: DataFrame, suggestions: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    """state with the suggestions (slug, check, level, detail, fence_index) for checked slugs."""
    return merge(state, _listed(state, suggestions, checked, "suggestions").select("slug", F.struct(F.col("items").alias("suggestions"), as_of.alias("suggestions_at")).alias("md")))


def set_refinement(state: DataFrame, rules: DataFrame, as_of: Column, conflicts: DataFrame | None = None) -> DataFrame:
    """state with the accepted rules (slug, then a rule's fields) and the conflicts of their replay (slug, conflicts)."""
    kind = state.schema["refinement"].dataType
    own = rules.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("fence_index", "check", "fingerprint", "content_sample", F.map_entries("fix").alias("fix")))).alias("r"))
    accepted = F.transform("r", lambda r: F.struct(r["check"].alias("check"), r["fence_index"].alias("fence_index"), r["fingerprint"].alias("fingerprint"), r["content_sample"].alias("content_sample"), F.map_from_entries(r["fix"]).alias("fix")))
    both = own if conflicts is None else own.join(conflicts.select("slug", "conflicts"), "slug", "left")
    lost = F.array().cast("array<string>") if conflicts is None else F.coalesce("conflicts", F.array().cast("array<string>"))
    return merge(state, both.select("slug", F.struct(accepted.cast(kind["accepted"].dataType).alias("accepted"), lost.alias("replay_conflicts"), as_of.alias("refined_at")).alias("refinement")))


def clear_refinement(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """state without the rules, conflicts and time of refinement of chosen slugs."""
    kind = state.schema["refinement"].dataType
    none = F.struct(F.array().cast(kind["accepted"].dataType).alias("accepted"), F.array().cast("array<string>").alias("replay_conflicts"))
    return merge(state, chosen.select("slug").distinct().select("slug", none.alias("refinement")), clear=("refinement.refined_at",))


ENRICHED = {"youtube_replaced": "youtube_replaced", "gists_replaced": "gists_replaced", "gists_failed": "gists_failed", "classes_normalised": "code_classes_normalised", "languages_detected": "languages_detected", "embeds_wrapped": "embeds_replaced"}


def mark_enriched(state: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """state with the counts that enrichment returned (slug, its counters) and the time."""
    return merge(state, done.select("slug", F.struct(as_of.alias("generated_at"), *[F.col(c).cast("int").alias(n) for n, c in ENRICHED.items()]).alias("enriched")))


def enrichment_totals(state: DataFrame) -> DataFrame:
    """How many posts are enriched and the sum of each counter."""
    return state.agg(F.count("enriched.generated_at").alias("posts"), *[F.coalesce(F.sum(f"enriched.{n}"), F.lit(0)).alias(n) for n in ENRICHED])


def save_md(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts (slug, md) with the edited ones in place of theirs; a text that is edited away to null is gone."""
    kept = texts.join(edits.select("slug"), "slug", "left_anti").select("slug", "md")
    return kept.unionByName(edits.select("slug", "md").filter("md IS NOT NULL"))


def bootstrap(state: DataFrame, files: DataFrame, sidecars: DataFrame, as_of: Column) -> DataFrame:
    """state with a row for each file (slug, html) that has none, its metadata from its sidecar if there is one, and
    with the hashes of changed files."""
    now = files.select("slug", short_hash(F.col("html")).alias("hash"))
    meta = ["title", "date", "author", "original_url"]
    new = now.join(state.select("slug"), "slug", "left_anti").join(sidecars.select("slug", *meta), "slug", "left")
    rows = new.select("slug", *[F.coalesce(c, F.lit("")).alias(c) for c in meta], as_of.alias("ingested_at"), F.struct("hash").alias("html"), F.lit(False).alias("flagged"), F.lit(False).alias("reviewed"))
    known = now.join(state.select("slug"), "slug", "left_semi").select("slug", F.struct("hash").alias("html"))
    return merge(merge(state, rows), known)


# ---- versions of Markdown: (slug, version, status, md), status one of live, staged, rejected


def stage(versions: DataFrame, drafts: DataFrame) -> DataFrame:
    """versions with a staged one of each draft (slug, md) in place of one staged before."""
    top = versions.groupBy("slug").agg(F.max("version").alias("top"))
    new = drafts.join(top, "slug", "left").select("slug", (F.coalesce("top", F.lit(0)) + 1).alias("version"), F.lit("staged").alias("status"), "md")
    old = versions.join(drafts.select("slug", F.lit("staged").alias("status")), ["slug", "status"], "left_anti")
    return old.select(new.columns).unionByName(new)


def accept(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions with the staged ones of chosen slugs live; what was live before is superseded."""
    has = versions.filter("status = 'staged'").join(chosen.select("slug").distinct(), "slug", "left_semi").select(F.col("slug").alias("k"))
    marked = versions.join(has, F.col("slug") == F.col("k"), "left")
    status = F.when(F.col("k").isNull(), F.col("status")).when(F.col("status") == "staged", "live").when(F.col("status") == "live", "superseded").otherwise(F.col("status"))
    return marked.select("slug", "version", status.alias("status"), "md")


def reject(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions without the staged ones of chosen slugs."""
    return versions.join(chosen.select("slug", F.lit("staged").alias("status")).distinct(), ["slug", "status"], "left_anti").select("slug", "version", "status", "md")


def current(original: DataFrame, enriched: DataFrame) -> DataFrame:
    """(slug, html, stage): the enriched page where there is one, else the original, which is never changed."""
    e = enriched.select("slug", F.col("html").alias("better"))
    return original.select("slug", "html").join(e, "slug", "left").select("slug", F.coalesce("better", "html").alias("html"), F.when(F.col("better").isNotNull(), "enriched").otherwise("original").alias("stage"))


def save_html(enriched: DataFrame, edits: DataFrame) -> DataFrame:
    """enriched with the edited pages (slug, html) in place of theirs."""
    return enriched.join(edits.select("slug"), "slug", "left_anti").select("slug", "html").unionByName(edits.select("slug", "html"))


def latest(rows: DataFrame, key: str = "slug", at: str = "ingested_at") -> DataFrame:
    """One row per key, the latest; repeated ingestion is idempotent."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
