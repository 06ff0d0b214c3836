"""Float vectors as vectors of integers, which the vector operators count with exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ListArray, dim: int, kind: type = np.int64) -> np.ndarray:
    """The lists of an Arrow column, all of `dim` numbers, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def largest_component(dim: int) -> int:
    """Up to here squared distances and inner products of `dim` components fit into 64 bits."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // max(1, dim)) // 2)


def integer_vectors(rows: DataFrame, scale: int, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with `vector`, floor(scale * x) of each component x as a double, instead of the vector column; and its length.

    Rows whose vector is null, empty or holds null or non-finite components are left out. So are vectors of another length
    than most have (of lengths that are as frequent, the longer one), since nothing compares with them. A component
    that leaves no room for 64-bit sums raises an error."""
    others = [c for c in rows.columns if c != vector_col]
    wide = rows.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    sound = wide.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = sound.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most.dim if most else 0
    limit = largest_component(dim)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(matrix(batch.column(len(others)), dim, np.float64) * float(scale))
            if values.size and np.abs(values).max() > limit:
                raise ValueError(f"a component is beyond {limit} after scaling by {scale}")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(values.astype(np.int32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*others, "vector"])

    fitting = sound.where(F.size("vector") == dim)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fitting.schema.fields[:-1]), "vector array<int>"])
    return fitting.mapInArrow(floors, schema), dim
