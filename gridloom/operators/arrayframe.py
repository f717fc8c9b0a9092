"""Typed dense arrays of rank 0 to 6 as DataFrames of coordinates (d0, d1, ...) and a value v.

Every cell has exactly one row and no null value. Arrays are immutable underneath: writing gives the handle a new DataFrame, so whoever read the
old one keeps it, and reads after writes see the new one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dtypes import ScalarType, literal, scalar_type
from ..functions.geometry import Bounds, Dim
from ..functions.scalar import div_trunc
from ..plans.domain import Distribution

if TYPE_CHECKING:
    from .access import Access

MAX_RANK = 6


def coordinates(rank: int) -> list[str]:
    return [f"d{k}" for k in range(rank)]


def index_space(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """Every point (d0, d1, ...) of a box."""
    sizes = [r.size for r in bounds]  # type: ignore[attr-defined]
    columns, step = [], prod(sizes)
    for k, (r, n) in enumerate(zip(bounds, sizes, strict=True)):
        step = step // n if n else 1
        columns.append(((div_trunc(F.col("id"), F.lit(max(1, step))) % F.lit(max(1, n))) + F.lit(r.begin)).cast("bigint").alias(f"d{k}"))  # type: ignore[attr-defined]
    return spark.range(prod(sizes)).select(*columns)


class ArrayFrame:
    """A handle: shape, cell type, chunk shape (inferred at the first write if not given), and the DataFrame of its cells."""

    def __init__(self, spark: SparkSession, shape: Sequence[int], dtype: object = "Float32", chunk: Sequence[int] | None = None, df: DataFrame | None = None, offset: Sequence[int] | None = None, root: ArrayFrame | None = None) -> None:
        if len(shape) > MAX_RANK:
            raise ValueError(f"rank {len(shape)} is over {MAX_RANK}")
        self.spark, self.shape, self.dtype = spark, Dim(shape), scalar_type(dtype)  # type: ignore[arg-type]
        self.chunk_shape = tuple(chunk) if chunk is not None else None
        self.offset = tuple(offset) if offset is not None else (0,) * len(shape)
        self._df = df
        self.root = root if root is not None else self  # the array that a view is of

    # ---- what an array is

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def columns(self) -> list[str]:
        return coordinates(self.rank)

    @property
    def volume(self) -> int:
        return self.shape.volume if self.rank else 1

    @property
    def is_empty(self) -> bool:
        return self.shape.is_empty

    @property
    def has_instance(self) -> bool:
        return self._df is not None

    def size(self, axis: int | None = None) -> int | Dim:
        """The sizes, or the size of one axis (1 beyond the rank)."""
        return self.shape if axis is None else self.shape.get(axis)  # type: ignore[return-value]

    @property
    def bounds(self) -> Bounds:
        return Bounds.from_offset_size(self.offset, self.shape)

    @property
    def distribution(self) -> Distribution:
        return Distribution(self.shape, self.chunk_shape or [max(1, s) for s in self.shape])

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError("the array was never written")
        return self._df

    def set(self, df: DataFrame, chunk: Sequence[int] | None = None) -> ArrayFrame:
        """Gives the handle new cells (d0.., v)."""
        self._df = df.select(*(F.col(c).cast("bigint").alias(c) for c in self.columns), F.col("v").cast(self.dtype.spark).alias("v"))
        if chunk is not None and self.chunk_shape is None:
            self.chunk_shape = tuple(chunk)
        return self

    def reset(self) -> None:
        """Forgets the cells; the array is as if never written."""
        if self._df is not None:
            self._df.unpersist()
        self._df = None

    def persist(self) -> ArrayFrame:
        self.df.persist()
        return self

    def with_chunk_id(self) -> DataFrame:
        moved = [F.col(c) - o for c, o in zip(self.columns, self.offset, strict=True)]
        return self.df.withColumn("chunk_id", self.distribution.chunk_id(moved))

    # ---- regions, for access modes

    def __getitem__(self, m: object) -> Access:
        from .access import Access

        return Access(self, ())[m]

    def __call__(self, *maps: object) -> Access:
        from .access import Access

        return Access(self, maps)

    # ---- views

    def _view(self, df: DataFrame, shape: Sequence[int], offset: Sequence[int]) -> ArrayFrame:
        return ArrayFrame(self.spark, shape, self.dtype, None, df, offset, self.root)

    def at(self, *index: int) -> ArrayFrame:
        """The sub-array at leading coordinates; IndexError out of bounds."""
        out = self
        for k in index:
            out = out.drop_axis(0, k)
        return out

    def value(self) -> object:
        """The cell of a rank-0 array."""
        if self.rank:
            raise ValueError("only an array of rank 0 is one value")
        return self.df.first()["v"]

    def drop_axis(self, axis: int, index: int | None = None) -> ArrayFrame:
        """Fixes one axis, by default at its first index. The condition is on the plain column, so it reaches the scan."""
        index = self.offset[axis] if index is None else index
        if not self.bounds[axis].contains(index):
            raise IndexError(f"index {index} isn't in axis {axis}")
        rest = [k for k in range(self.rank) if k != axis]
        df = self.df.where(F.col(f"d{axis}") == index).select(*(F.col(f"d{k}").alias(f"d{n}") for n, k in enumerate(rest)), "v")
        return self._view(df, [self.shape[k] for k in rest], [self.offset[k] for k in rest])

    def slice(self, box: Bounds) -> ArrayFrame:
        """The cells of a box, at their coordinates."""
        if not self.bounds.contains(box):
            raise IndexError("the box isn't inside of the array")
        df = self.df
        for c, r in zip(self.columns, box, strict=True):
            df = df.where((F.col(c) >= r.begin) & (F.col(c) < r.end))
        return self._view(df, [r.size for r in box], [r.begin for r in box])

    def shift_by(self, *steps: int) -> ArrayFrame:
        by = [*steps, *[0] * (self.rank - len(steps))]
        return self._view(self.df.select(*((F.col(c) + k).alias(c) for c, k in zip(self.columns, by, strict=True)), "v"), self.shape, [o + k for o, k in zip(self.offset, by, strict=True)])

    def shift_to(self, *place: int) -> ArrayFrame:
        return self.shift_by(*(p - o for p, o in zip(place, self.offset, strict=True)))

    def shift_to_origin(self) -> ArrayFrame:
        return self.shift_to(*[0] * self.rank)

    def shift_axis_by(self, axis: int, k: int) -> ArrayFrame:
        return self.shift_by(*(k if a == axis else 0 for a in range(self.rank)))

    def shift_axis_to(self, axis: int, place: int) -> ArrayFrame:
        return self.shift_axis_by(axis, place - self.offset[axis])

    def strides(self, order: str | Sequence[int] = "row") -> tuple[int, ...]:
        """How far neighbours along each axis stand apart in a row-major or column-major layout; strides of a layout of one's own stay as they are."""
        axes = range(self.rank)
        if not isinstance(order, str):
            if len(order) != self.rank:
                raise ValueError(f"{len(order)} strides for rank {self.rank}")
            return tuple(order)
        return tuple(prod(self.shape[k + 1 :]) if order == "row" else prod(self.shape[:k]) for k in axes)

    def linear_index(self, order: str | Sequence[int] = "row") -> Column:
        """The place of a cell in a layout ("row", "column" or strides), as a column."""
        out = F.lit(0).cast("bigint")
        for c, o, s in zip(self.columns, self.offset, self.strides(order), strict=True):
            out = out + (F.col(c) - o) * s
        return out

    def in_bounds(self, *index: Column) -> Column:
        out = F.lit(True)
        for i, r in zip(index, self.bounds, strict=True):
            out = out & (i >= r.begin) & (i < r.end)
        return out

    # ---- filling and copying

    def fill(self, value: object) -> ArrayFrame:
        """Every cell gets the value."""
        return self.set(index_space(self.spark, self.bounds).withColumn("v", literal(value, self.dtype)))

    def iota(self) -> ArrayFrame:
        """Every cell gets its row-major place."""
        return self.set(index_space(self.spark, self.bounds).withColumn("v", self.linear_index().cast(self.dtype.spark)))

    def copy_region(self, source: ArrayFrame, source_at: Sequence[int], at: Sequence[int], count: Sequence[int], source_step: Sequence[int] | None = None, step: Sequence[int] | None = None) -> ArrayFrame:
        """Copies a strided box of another array into this one; other cells stay as they are."""
        source_step, step = source_step or [1] * self.rank, step or [1] * self.rank
        df, moved = source.df, []
        for k, c in enumerate(self.columns):
            away = F.col(c) - source_at[k]
            df = df.where((F.col(c) >= source_at[k]) & (F.col(c) < source_at[k] + count[k] * source_step[k]) & (F.pmod(away, F.lit(source_step[k])) == 0))
            moved.append((div_trunc(away, F.lit(source_step[k])) * step[k] + at[k]).alias(c))
        new = df.select(*moved, F.col("v").alias("_new"))
        joined = self.df.join(new, self.columns, "left") if self.columns else self.df.crossJoin(new)
        return self.set(joined.select(*self.columns, F.coalesce("_new", "v").alias("v")))

    # ---- to host memory

    def copy_to(self) -> np.ndarray:
        """All cells as a row-major numpy array. Waits for the cells; RuntimeError unless every cell came exactly once."""
        kind = self.dtype.numpy
        got = (self.df.orderBy(*self.columns) if self.rank else self.df).toArrow().column("v").combine_chunks()
        if len(got) != self.volume:
            raise RuntimeError(f"{len(got)} cells instead of {self.volume}")
        if self.dtype.kind == "complex":
            return np.array([complex(x["re"], x["im"]) for x in got.to_pylist()], dtype=kind).reshape(self.shape)
        values = np.array([int(x) for x in got.to_pylist()], dtype=kind) if self.dtype.name == "Uint64" else got.to_numpy(zero_copy_only=False).astype(kind)
        return values.reshape(self.shape)

    def copy_to_vector(self) -> list:
        return self.copy_to().reshape(-1).tolist()

    def copy_bytes_to(self) -> bytes:
        return self.copy_to().tobytes()

    def copy_from(self, values: object) -> ArrayFrame:
        """Overwrites all cells; ValueError when the number of values isn't the volume."""
        from ..sources.host import cells_of

        flat = np.asarray(values).reshape(-1)
        if flat.size != self.volume:
            raise ValueError(f"{flat.size} values for {self.volume} cells")
        return self.set(cells_of(self.spark, flat.reshape(self.shape), self.dtype))

    def copy_bytes_from(self, raw: bytes) -> ArrayFrame:
        kind = np.dtype(self.dtype.numpy)
        if len(raw) % kind.itemsize:
            raise ValueError(f"{len(raw)} bytes aren't whole values of {kind.itemsize}")
        return self.copy_from(np.frombuffer(raw, kind))

    def __repr__(self) -> str:
        return f"ArrayFrame({tuple(self.shape)}, {self.dtype})"


def scalar(spark: SparkSession, value: object, dtype: ScalarType | str) -> ArrayFrame:
    """An array of rank 0."""
    return ArrayFrame(spark, (), dtype).fill(value)
