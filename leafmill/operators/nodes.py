"""The relation of page elements: every page is parsed once, everything after is filters, joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions import dom

#: Rows, and characters of text in them, that a task takes up or gathers at once. Arrow's batches have up to 10,000 rows,
#: and texts in Python several times their bytes.
PIECE_ROWS, PIECE_CHARS = 500, 1 << 21


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files are too few for them; large inputs and results of shuffles stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(n) if 0 < len(files) < n and df.sparkSession.sparkContext.defaultParallelism > 1 and _small(df) else df


def _small(df: DataFrame) -> bool:
    """Whether the optimiser's size of the plan would fill fewer partitions than there are cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < df.sparkSession.sparkContext.defaultParallelism * int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def map_rows(df: DataFrame, made: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that made returns for the values of each row of df. Only a piece of an Arrow batch is ever in Python's
    own objects, going in and coming out, so that memory does not follow the number or the length of a batch's rows."""

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size, step = 0, max(1, min(PIECE_ROWS, batch.num_rows * PIECE_CHARS // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                for values in zip(*(c.to_pylist() for c in batch.slice(at, step).columns)):
                    for row in made(*values):
                        out.append(row)
                        size += sum(len(v) for v in row if isinstance(v, (str, list)))
                        if len(out) >= PIECE_ROWS or size >= PIECE_CHARS:
                            yield _arrow(out, kinds)
                            out, size = [], 0
            if out:
                yield _arrow(out, kinds)

    return df.mapInArrow(run, schema)


def _arrow(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.types)], schema=kinds)


def dom_nodes(pages: DataFrame, key: str = "slug", html: str = "html") -> DataFrame:
    """(key, then the columns of dom.NODE_SCHEMA) for the elements of each page's article, else body.

    A page without either, as a null or empty one, has one row of number -1.
    """
    kind = pages.schema[key].dataType.simpleString()

    return map_rows(spread(pages.select(key, html)), lambda k, markup: ((k, *r) for r in dom.rows(markup)), f"{key} {kind}, {dom.NODE_SCHEMA}")


def attr(name: str) -> Column:
    """An attribute of the element, empty if it has none."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def count_inside(*tags: str) -> Column:
    """How many elements with these tags are below the element."""
    return sum((F.coalesce(F.try_element_at("inside", F.lit(t)), F.lit(0)) for t in tags), F.lit(0))


def within(*tags: str) -> Column:
    """Whether an element with one of these tags is above the element, up to the article."""
    return F.arrays_overlap("ancestors", F.array(*map(F.lit, tags)))
