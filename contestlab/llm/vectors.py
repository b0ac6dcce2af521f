"""Vectors as rows that numpy can read: little-endian floats or doubles in a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def number_type(df: DataFrame, vec_col: str = "embedding") -> str:
    """What the components of v are: floats if the column has floats, which says all that they say in half the bytes."""
    return "<f4" if isinstance(getattr(df.schema[vec_col].dataType, "elementType", None), FloatType) else "<f8"


def _packed(lists: pa.ListArray, kind: str) -> pa.Array:
    """The lists' bytes; null where a list is no usable vector."""
    at = lists.offsets.to_numpy()
    width = int(at[1] - at[0]) if len(lists) else 0
    if width and not lists.null_count and (np.diff(at) == width).all():
        x = lists.values[int(at[0]) : int(at[-1])].to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = norms(x)
        good = np.packbits((norm > 0) & (norm < np.inf), bitorder="little").tobytes()
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.strides[0]
        return pa.Array.from_buffers(pa.binary(), len(x), [pa.py_buffer(good), pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
    out = []
    for x in lists:
        a = np.array([np.nan if y is None else y for y in x.as_py()], kind) if x.is_valid else np.empty(0, kind)
        with np.errstate(over="ignore", invalid="ignore"):
            out.append(a.tobytes() if len(a) and 0 < norms(a[None])[0] < np.inf else None)
    return pa.array(out, pa.binary())


def as_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, rid, v): v null where the vector is null, empty, zero or holds a null or non-finite component, or where
    its norm overflows; rid numbers the rows. v's components are of number_type(df)."""
    kind = number_type(df, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(batch.column(2), kind)], names=["id", "rid", "v"])

    vector = F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>")
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), vector.alias("v"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, rid long, v binary")


def common_length(rows: DataFrame) -> int:
    """Bytes of the most common length of v (the longest of equally common ones), or 0 if there is no vector."""
    found = rows.where("v is not null").groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def matrix(column, kind: str) -> np.ndarray:
    """A binary Arrow column of equal lengths as rows of numbers of that type."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            _, ends, data = c.buffers()
            at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]).reshape(len(c), -1))
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty((0, 0), kind)


def norms(a: np.ndarray) -> np.ndarray:
    """In double precision."""
    a = a.astype(np.float64, copy=False)
    return np.sqrt(np.einsum("ij,ij->i", a, a))


def directions(a: np.ndarray) -> np.ndarray:
    """In double precision."""
    return a / norms(a)[:, None]
