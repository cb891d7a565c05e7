"""Vectors as a table: which ones count, classes of equal vectors, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) without ids or vectors that are null, and without vectors that are empty, zero or hold a null, NaN or infinity."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def classes(rows: DataFrame) -> DataFrame:
    """(rep, n, v, dim): each distinct vector once, with its smallest id and how many rows have it."""
    one = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    return cut(one.select("rep", "n", "v", F.size("v").alias("dim")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` numbers, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch with vectors of each length."""
    import pyarrow.compute as pc

    length = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        yield int(dim), batch.take(pa.array(np.flatnonzero(length == dim))) if len(np.unique(length)) > 1 else batch


def with_cosine(pairs: DataFrame, keep: list[str], least: float | None = None) -> DataFrame:
    """``keep`` columns and ``score``, the cosine of the columns va and vb in double precision; at least ``least``."""
    fields = [f for f in pairs.schema.fields if f.name in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double"
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch, "va") if batch.num_rows else ():
                for k in range(0, part.num_rows, 4096):
                    some = part.slice(k, 4096)
                    score = np.einsum("ij,ij->i", unit(matrix(some.column("va"), dim)), unit(matrix(some.column("vb"), dim)))
                    at = np.flatnonzero(score >= least) if least is not None else np.arange(len(score))
                    yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(at)) for c in names], pa.array(score[at])], [*names, "score"])

    return pairs.select(*names, "va", "vb").mapInArrow(run, schema)
