"""Vectors as exact integers, for the operators that need results without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256
LIMIT = 1 << 24


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 x) of every component. Beyond +-2**24 it is +-2**24, so that squared distances of
    up to a thousand components fit a long."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is finite; the label is null if there is none."""
    label = embeddings["label"] if "label" in embeddings.columns else F.lit(None).cast("int")
    rows = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), label.alias("label"), embeddings["embedding"].cast("array<double>").alias("vector"))
    return rows.filter(finite(F.col("vector"))).select("vec_id", "label", integers(F.col("vector")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as (rows, components)."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64)


def blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * int(np.prod(rows.shape[1:]))
    return pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def from_blobs(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    """The rows of ``blobs`` again, each of the given shape."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)
