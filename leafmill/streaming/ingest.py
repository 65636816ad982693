"""Ingestion of new files as a stream that ends when all are read, one run at a time for a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import pages

SCHEMA = "url string, status int, body string, error string, fetched_at timestamp"


class Ingest:
    """Takes fetched pages (JSON files of SCHEMA) from a folder into posts and errors, both Parquet."""

    def __init__(self, spark: SparkSession, project: str, source: str, target: str, author: str | None = None):
        self.spark, self.project, self.source, self.target, self.author = spark, project, source, target, author
        self.query = None

    def start(self):
        """Begin a run; refused while one of the project is active. Files read before are not read again."""
        if any(q.name == f"ingest-{self.project}" for q in self.spark.streams.active):
            raise RuntimeError("an ingest of this project is running")
        fetched = self.spark.readStream.schema(SCHEMA).json(self.source)
        self.query = (
            fetched.writeStream.queryName(f"ingest-{self.project}").option("checkpointLocation", f"{self.target}/checkpoint").trigger(availableNow=True).foreachBatch(self._batch).start()
        )
        return self.query

    def _batch(self, batch: DataFrame, number: int) -> None:
        # a batch that runs again overwrites what it wrote before
        once = batch.groupBy("url").agg(F.max_by(F.struct("status", "body", "error"), F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0)))).alias("r"), F.max("fetched_at").alias("fetched_at")).select("url", "r.*", "fetched_at")
        posts = pages.extract_posts(once).join(once.select("url", "fetched_at"), "url")
        if self.author:
            posts = posts.filter((F.col("error") != "") | F.contains(F.lower("author"), F.lit(self.author.lower())))
        posts.write.mode("overwrite").parquet(f"{self.target}/batches/batch={number}")

    def posts(self) -> DataFrame:
        """The posts of all batches, the latest of each slug."""
        from leafmill.operators.state import latest

        return latest(self.spark.read.parquet(f"{self.target}/batches").filter("error = ''"), "slug", "fetched_at")

    def errors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/batches").filter("error <> ''").select("url", "error")

    def status(self) -> dict:
        """Whether a run is active, and how many rows the last batches read."""
        if self.query is None:
            return {"running": False, "done": 0}
        return {"running": self.query.isActive, "done": sum(p["numInputRows"] for p in self.query.recentProgress), "message": self.query.status["message"]}

    def cancel(self) -> None:
        if self.query is not None:
            self.query.stop()
