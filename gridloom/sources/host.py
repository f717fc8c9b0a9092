"""Arrays from host memory (numpy, lists, bytes) and from tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.dtypes import ScalarType, scalar_type
from ..operators.arrayframe import ArrayFrame, coordinates


def cells_of(spark: SparkSession, values: np.ndarray, dtype: ScalarType) -> DataFrame:
    """The cells (d0.., v) of a numpy array, sent as one Arrow table."""
    flat = values.reshape(-1)
    index = np.unravel_index(np.arange(flat.size), values.shape) if values.ndim else ()
    if dtype.kind == "complex":
        part = pa.float32() if dtype.bits == 64 else pa.float64()
        v = pa.StructArray.from_arrays([pa.array(flat.real, part), pa.array(flat.imag, part)], ["re", "im"])
    elif dtype.name == "Uint64":
        v = pa.array([int(x) for x in flat], pa.decimal128(20, 0))
    else:
        wider = {"Uint8": pa.int16(), "Uint16": pa.int32(), "Uint32": pa.int64()}
        v = pa.array(flat, wider[dtype.name]) if dtype.name in wider else pa.array(flat.astype(dtype.numpy))
    arrays = [*(pa.array(i.astype(np.int64)) for i in index), v]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, [*coordinates(values.ndim), "v"]))


def allocate(spark: SparkSession, values: object, dtype: object = None, shape: Sequence[int] | None = None) -> ArrayFrame:
    """An array of host values in one chunk. `shape` reads flat values row-major; their number must be its volume."""
    data = np.asarray(values)
    kind = scalar_type(dtype if dtype is not None else data.dtype)  # type: ignore[arg-type]
    if shape is not None:
        data = data.reshape(tuple(int(s) for s in shape))
    out = ArrayFrame(spark, data.shape, kind, data.shape)
    return out.set(cells_of(spark, data.astype(kind.numpy), kind))


def from_table(df: DataFrame, coords: Sequence[str | Column], value: str | Column, shape: Sequence[int], dtype: object, chunk: Sequence[int] | None = None) -> ArrayFrame:
    """A table whose rows are the cells of an array. The caller answers for there being one row for each cell."""
    from pyspark.sql import functions as F

    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    cells = df.select(*(as_column(c).alias(f"d{k}") for k, c in enumerate(coords)), as_column(value).alias("v"))
    return ArrayFrame(df.sparkSession, shape, dtype, chunk).set(cells)
