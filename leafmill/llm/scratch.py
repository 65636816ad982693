"""Tables written to the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()

def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, a folder of this application in the
    warehouse, which executors share too. A local one goes when the driver's process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{spark.sparkContext.applicationId}"
    local = re.sub("^file:/*", "/", own)
    if local.startswith("/") and local not in _own:
        _own.add(local)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return own


class Table:
    """A DataFrame written as Parquet in the shared folder."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/leafmill/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read the table after this."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Buckets(Table):
    """A DataFrame written to the shared folder in n buckets by the keys: joins and groups by them need no shuffle."""

    def __init__(self, df: DataFrame, name: str, n: int, *keys: str, shuffle: bool = True, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/leafmill/{self.name}"
        dealt = df.repartition(n, *keys) if shuffle else df
        dealt.write.bucketBy(n, *keys).option("compression", compression).option("path", self.path).saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        super().drop()


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle makes, as the session is configured."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Return freed memory of this Python worker, which Spark keeps for later tasks, to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
