"""Reductions of contributions into array cells: the only aggregation of the engine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import ScalarType, UnsupportedReduction, identity, literal, scalar_type, supports, wrap


def as_signed(v: Column) -> Column:
    """An unsigned 64-bit decimal as the bigint with the same bits."""
    v = v.cast("decimal(20,0)")
    return F.when(v >= F.lit(Decimal(1 << 63)), v - F.lit(Decimal(1 << 64))).otherwise(v).cast("bigint")


def as_unsigned(v: Column) -> Column:
    v = v.cast("decimal(20,0)")
    return F.when(v < 0, v + F.lit(Decimal(1 << 64))).otherwise(v).cast("decimal(20,0)")


def aggregate(op: str, v: Column, dtype: ScalarType) -> Column:
    """A built-in aggregate with the type's rules: results keep the type, integers wrap, NaN doesn't take part in min and max.

    Not for products of integers and complex numbers, which no built-in aggregate gives exactly. No rows give the identity.
    """
    if not supports(dtype, op):
        raise UnsupportedReduction(f"{op} isn't defined for {dtype}")
    if dtype.kind == "complex":
        return F.struct(F.coalesce(F.sum(v["re"]), F.lit(0.0)).alias("re"), F.coalesce(F.sum(v["im"]), F.lit(0.0)).alias("im")).cast(dtype.spark)
    start = literal(identity(dtype, op), dtype)
    if op == "sum":
        found = F.sum(v.cast("double")).cast(dtype.spark) if dtype.kind == "float" else wrap(F.sum(v.cast("bigint" if dtype.bits < 64 else "decimal(20,0)")), dtype)
    elif op == "product":
        found = F.product(v.cast("double")).cast(dtype.spark)
    elif op in ("min", "max"):
        v = F.when(~F.isnan(v), v) if dtype.kind == "float" else v
        found = (F.min if op == "min" else F.max)(v).cast(dtype.spark)
    else:
        bits = F.bit_and if op == "bit_and" else F.bit_or
        found = as_unsigned(bits(as_signed(v))) if dtype.name == "Uint64" else bits(v).cast(dtype.spark)
    return F.coalesce(found, start)


def _folded(df: DataFrame, keys: list[str], dtype: ScalarType) -> DataFrame:
    """Products of integers (modulo 2**bits) or complex numbers, by numpy: a partial product for each key and batch, then, sorted by key, one of those.

    A key has at most one partial row for each batch of the input. The sorted rows are folded as a stream, so neither a key nor a task is
    held whole, and Python is called once for each batch.
    """
    complex_ = dtype.kind == "complex"
    v = (F.col("v.re").cast("double"), F.col("v.im").cast("double")) if complex_ else ((as_signed(F.col("v")) if dtype.name == "Uint64" else F.col("v").cast("bigint")), F.lit(0).cast("bigint"))
    wide = df.select(*keys, v[0].alias("re"), v[1].alias("im"))

    def fold(table: pa.Table) -> pa.Table:
        """One row for each key of the table, keys in their order of appearance if they are sorted."""
        if not table.num_rows:
            return table
        groups = np.zeros(table.num_rows, np.int64)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            groups = np.unique(groups * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        order = np.argsort(groups, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0]))
        re = table.column("re").to_numpy()[order]
        values = re + 1j * table.column("im").to_numpy()[order] if complex_ else re
        out = np.multiply.reduceat(values, starts)
        turn = np.argsort(order[starts], kind="stable")
        rows = table.take(pa.array(order[starts][turn]))
        for name, part in (("re", out.real), ("im", out.imag if complex_ else np.zeros(len(out), np.int64))):
            rows = rows.set_column(rows.schema.get_field_index(name), table.schema.field(name), pa.array(part[turn]))  # the field, as nullability must stay
        return rows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fold(pa.Table.from_batches([b])).to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for b in batches:
            rows = fold(pa.concat_tables([t for t in (last, pa.Table.from_batches([b])) if t is not None]))
            if rows.num_rows:
                yield from rows.slice(0, rows.num_rows - 1).to_batches()
                last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield from last.to_batches()

    parts = wide.mapInArrow(partial, wide.schema)
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    done = dealt.mapInArrow(final, wide.schema)
    if complex_:
        return done.select(*keys, F.struct("re", "im").cast(dtype.spark).alias("v"))
    return done.select(*keys, (as_unsigned(F.col("re")) if dtype.name == "Uint64" else wrap(F.col("re"), dtype)).alias("v"))


def reduce_cells(contributions: DataFrame, op: str, dtype: str | ScalarType, keys: Sequence[str], cells: DataFrame | None = None, private: Sequence[str] = ()) -> DataFrame:
    """(keys, v): the contributions (keys, private keys, v) of each cell reduced.

    With `cells` (keys) every cell has a row, holding the identity without contributions. Private keys make a first level of partial
    results, which are reduced to the cells. Old contents of the target don't take part.
    """
    dtype, keys = scalar_type(dtype), list(keys)
    start = identity(dtype, op)
    if op == "product" and dtype.kind != "float" and supports(dtype, op):
        out = _folded(contributions.select(*keys, "v"), keys, dtype)
    else:
        levels = [[*keys, *private], keys] if private else [keys]
        out = contributions
        for level in levels:
            out = out.groupBy(*level).agg(aggregate(op, F.col("v"), dtype).alias("v"))
    if cells is not None:
        out = cells.join(out, keys, "left").select(*keys, F.coalesce("v", literal(start, dtype)).alias("v"))
    return out


def arg_min(df: DataFrame, keys: Sequence[str], value: str, key: str) -> DataFrame:
    """(keys, value, key) of the smallest pair (value, key) of each group."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(value).alias("value"), F.col(key).alias("key"))).alias("p")).select(*keys, "p.value", "p.key")


def arg_max(df: DataFrame, keys: Sequence[str], value: str, key: str) -> DataFrame:
    """(keys, value, key) of the largest pair (value, key) of each group."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("value"), F.col(key).alias("key"))).alias("p")).select(*keys, "p.value", "p.key")
