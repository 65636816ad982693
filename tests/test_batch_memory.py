"""Python's memory for one Arrow batch: pieces of it, not all its rows and texts at once."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

from leafmill.operators import pages, validate
from leafmill.operators.nodes import dom_nodes

TEXT = "<article><p>" + "word" * 2500 + "</p></article>"
FENCED = "```java\n" + "int a;" * 1700 + "\n" + "```\n"


def _peak(run, batch) -> tuple[int, int]:
    """MB of Python's own objects at most while run reads the batch, and the rows that it makes."""
    tracemalloc.start()
    rows = sum(len(x) if isinstance(x, pd.DataFrame) else x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak // 1_000_000, rows


@pytest.mark.parametrize("operator, text, rows, most", [(dom_nodes, TEXT, 2, 20), (pages.fences, FENCED, 1, 7), (validate.facts, TEXT, 1, 10)])
def test_long_texts_of_a_batch(spark, monkeypatch, operator, text, rows, most):
    column = "md" if operator is pages.fences else "html"
    given = spark.createDataFrame([("k", "")], f"slug string, {column} string")
    caught = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(given), name, lambda self, f, schema, name=name, real=getattr(type(given), name): (caught.append((name, f)), real(self, f, schema))[1])
    operator(given)
    n = 900
    frame = pd.DataFrame({"slug": [str(k) for k in range(n)], column: [text + str(k) for k in range(n)]})
    name, run = caught[0]
    peak, found = _peak(run, frame if name == "mapInPandas" else pa.RecordBatch.from_pandas(frame, preserve_index=False))
    assert found == n * rows and peak < most
