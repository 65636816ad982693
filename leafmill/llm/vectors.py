"""What the vector operators share: which vectors count, and their packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero, and hold no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def sizes(vectors: DataFrame, column: str) -> dict[int, int]:
    """How many usable vectors there are of each number of components; vectors are held against those of their size."""
    rows = vectors.filter(usable(F.col(column))).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("rows")).collect()
    return {r["n"]: r["rows"] for r in sorted(rows)}


def matrix(series) -> np.ndarray:
    """A column of usable vectors of one size as rows of doubles."""
    return np.array(series.tolist(), dtype=np.float64).reshape(len(series), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest components first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
