"""Sources and sinks of archives: pages, sidecars, state, assets, configuration and fetched addresses."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import state

USER_AGENT = "Mozilla/5.0 (compatible; archive)"
TIMEOUT_S = 20
SIDECAR = "title string, date string, author string, categories array<string>, tags array<string>, original_url string"


def _stem(column: str = "_metadata.file_path"):
    return F.regexp_extract(column, r"([^/]+)\.[^./]+$", 1)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, html) of the HTML files of a folder."""
    return spark.read.text(f"{folder}/*.html", wholetext=True).select(_stem().alias("slug"), F.col("value").alias("html"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, metadata) of the JSON files beside pages; malformed ones have nulls."""
    return spark.read.schema(SIDECAR).option("multiLine", True).json(f"{folder}/*.json").select(_stem().alias("slug"), "*")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per slug of a state document, which is one JSON object by slug; an unreadable one gives none."""
    inner = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spark.createDataFrame([], state.SCHEMA).schema if f.name != "slug")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{inner}>>").alias("m"))
    return whole.select(F.explode("m").alias("slug", "e")).select("slug", "e.*")


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, slug, sha256, n_bytes) of the files under a folder of assets by post; contents are hashed, not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_extract("path", r"(assets/.*)$", 1)
    return files.select(rel.alias("path"), F.regexp_extract("path", r"posts/([^/]+)/[^/]+$", 1).alias("slug"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def read_url_index(spark: SparkSession, path: str) -> DataFrame:
    """(url, path) of an index, which is one JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "path"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, name string, created_at string").option("multiLine", True).json(path)


@dataclass
class Config:
    """A project's places; relative ones are under serve_root."""

    serve_root: Path
    posts_dir: Path
    assets_dir: Path
    md_dir: Path
    enriched_dir: Path
    author: str = ""
    options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, project_dir: str) -> Config:
        raw = json.loads(Path(path).read_text()) if os.path.exists(path) else {}
        root = Path(raw.get("serve_root") or project_dir)
        at = lambda section, key, default: root / (raw.get(section) or {}).get(key, default)
        return cls(root, at("source", "posts_dir", "legacy/posts"), at("source", "assets_dir", "legacy/assets"), at("output", "md_dir", "output/md"), Path(project_dir) / "enriched", (raw.get("filter") or {}).get("author", ""), raw)


def http_bytes(url: str) -> tuple[int, bytes, str]:
    """The status, bytes and character set of an address, whatever the status; the only place that uses the network."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=TIMEOUT_S) as answer:
            return answer.status, answer.read(), answer.headers.get_content_charset() or "utf-8"
    except urllib.error.HTTPError as answer:
        return answer.code, answer.read(), "utf-8"


def http_get(url: str) -> tuple[int, str]:
    """The status and text of an address."""
    status, body, charset = http_bytes(url)
    return status, body.decode(charset, "replace")


def _fetched(addresses: DataFrame, get: Callable[[str], tuple], body: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:  # a row at a time, so that no batch of bodies is held
                try:
                    status, found = get(url)[:2]
                    row = (url, status, found, None)
                except Exception as wrong:  # one address must not stop the others
                    row = (url, None, None, f"Fetch error: {wrong}")
                yield pd.DataFrame([row], columns=["url", "status", "body", "error"]).astype({"status": "Int32"})

    return addresses.select("url").mapInPandas(run, f"url string, status int, body {body}, error string")


def fetch(addresses: DataFrame, get: Callable[[str], tuple[int, str]] = http_get) -> DataFrame:
    """(url, status, body, error) of addresses (url); a status other than 200 is no error here, what breaks is. get takes
    the place of the network in tests."""
    return _fetched(addresses, get, "string")


def download(addresses: DataFrame, get: Callable[[str], tuple] = http_bytes) -> DataFrame:
    """(url, status, body, error) of assets (url), with their bytes."""
    return _fetched(addresses, get, "binary")


def export_assets(assets: DataFrame, folder: str) -> None:
    """A file for each asset (path, body) under a folder that all tasks share; whole or not at all."""

    def write(rows) -> None:
        for row in rows:
            target = os.path.normpath(os.path.join(folder, row["path"]))
            if not target.startswith(os.path.join(os.path.normpath(folder), "")):
                raise ValueError(f"{row['path']} leads out of the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(row["body"] or b"")
            os.replace(part, target)

    assets.select("path", "body").foreachPartition(write)


ARCHIVE = "https://archive.org/wayback/available?url="  # a fixed value: the public archive's lookup
GISTS = "https://api.github.com/gists/"  # a fixed value: the public address of a gist's files


def archived(addresses: DataFrame, get: Callable[[str], tuple[int, str]] = http_get) -> DataFrame:
    """(url, archived) of addresses (url): the closest snapshot that the archive's answer names, null without one."""
    asked = addresses.select("url", F.concat(F.lit(ARCHIVE), F.url_encode("url")).alias("ask"))
    answers = fetch(asked.select(F.col("ask").alias("url")).distinct(), get).withColumnRenamed("url", "ask")
    closest = F.get_json_object("body", "$.archived_snapshots.closest.url")
    return asked.join(answers, "ask", "left").select("url", F.when(F.col("status") == 200, F.nullif(closest, F.lit(""))).alias("archived"))


def read_gists(ids: DataFrame, get: Callable[[str], tuple[int, str]] = http_get) -> DataFrame:
    """(gist_id, files) of gists (gist_id) that answer with 200, by file name."""
    asked = ids.select("gist_id", F.concat(F.lit(GISTS), "gist_id").alias("url")).distinct()
    files = F.from_json(F.get_json_object("body", "$.files"), "map<string,struct<filename:string,language:string,content:string>>")
    found = fetch(asked.select("url"), get).filter("status = 200").join(asked, "url")
    listed = F.transform(F.array_sort(F.map_entries(files)), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"]["language"], F.lit("")).alias("language"), F.coalesce(e["value"]["content"], F.lit("")).alias("content")))
    return found.select("gist_id", listed.alias("files")).filter("files IS NOT NULL")


def write_snapshot(df: DataFrame, path: str, *by: str) -> None:
    """Write a stage's rows as a new snapshot; sources are never written to."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def export(df: DataFrame, folder: str, name: str, content: str, end: str) -> None:
    """A file for each row, named by a column, written by the tasks that hold the rows to a folder that all share.
    A file appears whole or not at all, and a task that runs again writes the same."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row[name]}.{os.getpid()}")
            with open(part, "w", encoding="utf-8") as f:
                f.write(row[content] or "")
            os.replace(part, os.path.join(folder, f"{row[name]}{end}"))

    df.select(name, content).foreachPartition(write)
