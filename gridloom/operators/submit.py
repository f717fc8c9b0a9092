"""Submitting a kernel over the chunks of a domain.

A kernel is either a function of columns, which stays in Catalyst, or a numpy function of whole chunks, which runs in Arrow batches.
Both give lazy DataFrames: Spark orders, places and pipelines the work. A submission has one or more targets: the first one, and every
write(...) or reduce(...) among the other arguments, in their order, which is that of the values that the kernel returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields, is_dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dtypes import ScalarType
from ..functions.geometry import Bounds
from ..plans.domain import AXES, Distribution, into_domain
from ..plans.mapper import IndexMap, region
from .access import Access, _access, check_aliases
from .arrayframe import ArrayFrame, coordinates, index_space
from .reduce import as_signed, as_unsigned, reduce_cells

#: Chunks whose numbers are broadcast when each of them reads a whole array that is one chunk.
BROADCAST_CHUNKS = 1_000_000

#: Bytes of an array's chunk, up to which chunks meet in pairs as rows.
BLOCK_BYTES = 1 << 25

#: Partitions of each side when all blocks of two tables meet; there are as many tasks as pairs of them.
SIDE_PARTITIONS = 32

#: Cells of a written region that leave the kernel's worker at once.
SLICE = 1 << 18


@dataclass(frozen=True)
class ExprKernel:
    """f(index columns, *argument columns) -> the value of each cell, as a column; with several targets a tuple of columns."""

    f: Callable[..., Column]


@dataclass(frozen=True)
class ChunkKernel:
    """f(chunk, *arrays) -> the values of the written region, in numpy; chunk is the Bounds of the work chunk. Scalars come as they are.

    With several targets f returns a tuple. A target with private axes takes an array that has these axes before its own. symmetric promises
    that f, of a chunk with the two axes of its target changed over (and its two regions with them), is the transpose of f of the chunk.
    """

    f: Callable[..., np.ndarray]
    symmetric: bool = False


def expand(args: Sequence[object]) -> list[object]:
    """Arguments with dataclasses replaced by their fields, in order."""
    out: list[object] = []
    for a in args:
        if is_dataclass(a) and not isinstance(a, (Access, IndexMap, type)):
            out += expand([getattr(a, f.name) for f in fields(a)])
        else:
            out.append(a)
    return out


def _sorted_out(target: Access, args: Sequence[object]) -> tuple[list[Access], list[object], list[tuple[int, Access]]]:
    """The targets, the other arguments, and the places of the arrays among these."""
    every = expand([target, *args])
    targets = [a for a in every if isinstance(a, Access) and a.mode != "read"]
    rest = [a for a in every if not (isinstance(a, Access) and a.mode != "read")]
    reads = [(n, _access(a)) for n, a in enumerate(rest) if isinstance(a, (ArrayFrame, Access))]
    check_aliases([*targets, *(a for _, a in reads)])
    return targets, rest, reads


def _results(targets: list[Access]) -> ArrayFrame | tuple[ArrayFrame, ...]:
    return targets[0].array if len(targets) == 1 else tuple(t.array for t in targets)


def _point_maps(a: Access, size: Sequence[int]) -> tuple[IndexMap, ...]:
    """The maps of an access that touches one cell for each point of a domain; IndexError where a point has none."""
    maps = a.resolved() if a.maps else tuple(IndexMap(k) for k in range(a.array.rank))
    for m, extent in zip(maps, a.array.shape, strict=True):
        n = size[m.axis] if m.axis < len(size) else 1
        if m.length != 1:
            raise ValueError("an element-wise kernel touches one cell of each array for each point")
        if prod(size) == 0:
            continue
        low = m.offset + min(0, m.scale * (n - 1))
        reached = m.interval(0, n)
        if low < 0 or reached.begin < 0 or reached.end > extent:
            raise IndexError(f"{m} reaches {reached} of {extent} cells")
    return maps


def _at(maps: Sequence[IndexMap], rank: int) -> list[Column]:
    """Cell coordinates, as columns of the points d0, d1, ..."""
    one, zero = F.lit(1), F.lit(0).cast("bigint")
    return [m.apply(F.col(f"d{m.axis}") if m.axis < rank else zero, one)[0].cast("bigint") for m in maps]


def _plain_axes(maps: Sequence[IndexMap]) -> list[int] | None:
    """The axes of maps that are different plain axes, so that cells meet points by equal coordinates; else None."""
    plain = [m.axis for m in maps if m == IndexMap(m.axis)]
    return plain if len(plain) == len(maps) == len(set(plain)) else None


def elementwise(spark: SparkSession, size: Sequence[int], kernel: ExprKernel, target: Access, *args: object) -> ArrayFrame | tuple[ArrayFrame, ...]:
    """Writes or reduces kernel(index, args) for each point of a domain. Arrays are read by maps of one cell for each point (plain axes,
    affine maps, constants) and meet the points by equi-joins on these cells.

    IndexError if a map reaches out of its array for some point, so that no point is lost. Cells of a target that no point writes stay as
    they are; the first write must cover the array. A written target has one map for each axis of the domain, without a divisor.
    """
    targets, rest, reads = _sorted_out(target, args)
    rank = len(size)
    maps = {n: _point_maps(a, size) for n, a in reads}
    into = [_point_maps(t, size) for t in targets]
    joined: DataFrame | None = None
    simple = {n: axes for n, m in maps.items() if (axes := _plain_axes(m)) is not None}
    for n, a in sorted(reads, key=lambda r: (r[0] not in simple, -len(simple.get(r[0], ())), r[0])):
        if n in simple:
            axes = simple[n]
            cells = a.array.df.select(*(F.col(f"d{k}").alias(f"d{x}") for k, x in enumerate(axes)), F.col("v").alias(f"a{n}"))
            if joined is not None:
                joined = joined.join(cells, [f"d{x}" for x in axes]) if axes else joined.crossJoin(F.broadcast(cells))  # rank 0: one row
            elif sorted(axes) == list(range(rank)):
                joined = cells
                for k, x in enumerate(axes):
                    if a.array.shape[k] != size[x]:  # the array reaches beyond the domain
                        joined = joined.where(F.col(f"d{x}") < size[x])
            else:
                points = index_space(spark, Bounds.of(size))
                joined = points.join(cells, [f"d{x}" for x in axes]) if axes else points.crossJoin(F.broadcast(cells))
        else:
            keys = [f"k{k}" for k in range(a.array.rank)]
            cells = a.array.df.select(*(F.col(f"d{k}").alias(c) for k, c in enumerate(keys)), F.col("v").alias(f"a{n}"))
            joined = (index_space(spark, Bounds.of(size)) if joined is None else joined).withColumns(dict(zip(keys, _at(maps[n], rank), strict=True))).join(cells, keys).drop(*keys)
    points = joined if joined is not None else index_space(spark, Bounds.of(size))
    columns = [F.col(f"a{n}") if n in maps else F.lit(a) for n, a in enumerate(rest)]
    made = kernel.f([F.col(c) for c in coordinates(rank)], *columns)
    values = made if isinstance(made, (tuple, list)) else (made,)
    if len(values) != len(targets):
        raise ValueError(f"{len(values)} values for {len(targets)} targets")
    for t, m, v in zip(targets, into, values, strict=True):
        rows = points.select(*(F.col(c) for c in coordinates(rank)), v.cast(t.array.dtype.spark).alias("v"))
        (_reduce_points if t.mode == "reduce" else _write_points)(rows, size, t, m)
    return _results(targets)


def _write_points(rows: DataFrame, size: Sequence[int], target: Access, maps: tuple[IndexMap, ...]) -> None:
    out = target.array
    if sorted(m.axis for m in maps) != list(range(len(size))) or any(m.scale == 0 or m.divisor != 1 for m in maps):
        raise ValueError("an element-wise kernel writes a cell of its own for each point")
    made = rows.select(*(c.alias(f"d{k}") for k, c in enumerate(_at(maps, len(size)))), "v")
    if prod(size) != out.volume:  # each point has a cell of its own, so as many points as cells cover the array
        if not out.has_instance:
            raise ValueError("the first write must cover the array")
        made = _replaced(out, made)
    out.set(made)


def _replaced(out: ArrayFrame, made: DataFrame) -> DataFrame:
    """The cells of an array, with those of `made` in their places."""
    new = made.select(*out.columns, F.struct("v").alias("_new"))
    joined = out.df.join(new, out.columns, "left") if out.rank else out.df.crossJoin(F.broadcast(new))
    return joined.select(*out.columns, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col("v")).alias("v"))


def _reduce_points(rows: DataFrame, size: Sequence[int], target: Access, maps: tuple[IndexMap, ...]) -> None:
    out = target.array
    keys, private = out.columns, [f"p{n}" for n in range(len(target.private))]
    moved = rows.select(*(c.alias(k) for k, c in zip(keys, _at(maps, len(size)), strict=True)), *(c.alias(p) for p, c in zip(private, _at(target.private, len(size)), strict=True)), "v")
    axes = _plain_axes(maps)
    covered = axes is not None and all(out.shape[k] == size[x] for k, x in enumerate(axes)) and prod(size) > 0
    cells = None if covered or not out.rank else index_space(out.spark, Bounds.of(out.shape))
    out.set(reduce_cells(moved, target.op or "sum", out.dtype, keys, cells, private))


def reduce_elements(spark: SparkSession, size: Sequence[int], kernel: ExprKernel, target: Access, *args: object) -> ArrayFrame | tuple[ArrayFrame, ...]:
    """Reduces kernel(index, args) over a domain into target = reduce(op, [privatize(..),] array[maps]); cells that no point reaches hold the identity."""
    if target.mode != "reduce" or target.op is None:
        raise ValueError("the target must be reduce(op, array)")
    if not target.maps and target.array.rank:
        raise ValueError("a reduction needs a map for each axis of its target")
    return elementwise(spark, size, kernel, target, *args)


def chunk_regions(chunks: DataFrame, access: Access) -> DataFrame:
    """chunks with b0, e0, b1, ...: the region of the array that each chunk touches, clipped to it (an error for one_to_one, which isn't clipped)."""
    out = chunks
    for k, m in enumerate(access.resolved()):
        begin, end = m.apply(F.col(f"o{m.axis}"), F.col(f"s{m.axis}"))
        size = F.lit(access.array.shape[k])
        if access.clipped:
            out = out.withColumns({f"b{k}": F.greatest(begin, F.lit(0)), f"e{k}": F.least(end, size)})
        else:
            beyond = F.raise_error(F.lit("a region isn't inside of the array")).cast("bigint")
            out = out.withColumns({f"b{k}": F.when((begin < 0) | (end > size), beyond).otherwise(begin), f"e{k}": end})
    return out


def _array_chunks(chunks: DataFrame, access: Access, strict: bool) -> DataFrame:
    """chunks with their regions (b0, e0, ...) and array_chunk, the array's chunk that a region lies in; with strict=False a row for each that it touches."""
    regions = chunk_regions(chunks, access)
    grid = access.array.distribution
    first, places = F.lit(0).cast("bigint"), []
    crosses = F.lit(False)
    for k, (c, n) in enumerate(zip(grid.chunk, grid.counts, strict=True)):
        low = F.floor(F.col(f"b{k}") / c).cast("bigint")
        high = F.floor((F.greatest(F.col(f"e{k}"), F.col(f"b{k}") + 1) - 1) / c).cast("bigint")
        crosses = crosses | (low != high)
        first = first * n + low
        places.append((k, low, high, n))
    if strict:
        return regions.withColumn("array_chunk", F.when(crosses, F.raise_error(F.lit("a region lies in more than one chunk")).cast("bigint")).otherwise(first))
    regions = regions.withColumn("array_chunk", F.lit(0).cast("bigint"))
    for k, low, high, n in places:
        regions = regions.withColumn("_at", F.explode(F.sequence(low, F.least(high, F.lit(n - 1))))).withColumn("array_chunk", F.col("array_chunk") * n + F.col("_at")).drop("_at")
    return regions


def touched_cells(chunks: DataFrame, access: Access, strict: bool = True) -> DataFrame:
    """(chunk_id, d0.., v): the cells that each work chunk reads.

    A region must lie in one chunk of the array, whose number then is an equi-join key; strict=False also takes regions that cross chunks
    (halos), with a row for each array chunk that is touched. Of an array that is one chunk every cell has the same key, so the (small) table of
    work chunks is broadcast to the cells.
    """
    array = access.array
    grid, regions = array.distribution, _array_chunks(chunks, access, strict)
    wanted = regions.select("chunk_id", "array_chunk", *(f"{x}{k}" for k in range(array.rank) for x in "be"))
    if grid.num_chunks == 1 and chunks.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS:
        wanted = F.broadcast(wanted)
    cells = array.with_chunk_id().withColumnRenamed("chunk_id", "array_chunk")
    joined = cells.join(wanted, "array_chunk")
    for k in range(array.rank):
        joined = joined.where((F.col(f"d{k}") >= F.col(f"b{k}")) & (F.col(f"d{k}") < F.col(f"e{k}")))
    return joined.select("chunk_id", *array.columns, "v")


def written_chunks(chunks: DataFrame, target: Access, allow_duplicates: bool = False) -> Distribution:
    """The distribution that the regions of a domain's chunks give an array (as Distribution.from_chunks, but on the chunk table).

    The region at the origin gives the chunk size. ValueError unless all regions are aligned, of that size (or clipped) and cover the
    array, each place once (unless duplicates are allowed).
    """
    shape, rank = tuple(target.array.shape), target.array.rank
    regions = chunk_regions(chunks, target)
    b, e = ([F.col(f"{x}{k}") for k in range(rank)] for x in "be")
    every = lambda conditions: F.lit(True) if not (c := list(conditions)) else F.forall(F.array(*c), lambda x: x)
    at_origin = every(x == 0 for x in b)
    found = regions.where(at_origin).agg(F.count("*").alias("n"), *(F.max(x).alias(f"c{k}") for k, x in enumerate(e))).first()
    if not found["n"]:
        if 0 in shape:
            return Distribution(shape, [1] * rank)
        raise ValueError("no chunk at the origin")
    size = [found[f"c{k}"] for k in range(rank)]
    if any(c <= 0 for c in size):
        raise ValueError("chunk size is empty")
    grid = Distribution(shape, size)
    index = F.lit(0).cast("bigint")
    for x, c, n in zip(b, size, grid.counts, strict=True):
        index = index * n + F.floor(x / c).cast("bigint")
    aligned = every(x % c == 0 for x, c in zip(b, size, strict=True))
    sized = every(y == F.least(x + c, F.lit(s)) for x, y, c, s in zip(b, e, size, shape, strict=True))
    got = regions.agg(F.count("*").alias("all"), F.count_distinct(index).alias("places"), F.sum((~aligned).cast("int")).alias("askew"), F.sum((~sized).cast("int")).alias("odd")).first()
    for bad, text in ((got["askew"], "aren't aligned"), (got["odd"], "have the wrong size"), (grid.num_chunks - got["places"], "are missing")):
        if bad:
            raise ValueError(f"{bad} chunks {text}")
    if got["all"] != got["places"] and not allow_duplicates:
        raise ValueError("two chunks write one place")
    return grid


def _packed(dtype: ScalarType, v: Column) -> list[Column]:
    """A cell value as (x double, y double, w bigint), one of which (two for complex numbers) holds it."""
    none, zero = F.lit(0.0), F.lit(0).cast("bigint")
    if dtype.kind == "complex":
        return [v["re"].cast("double"), v["im"].cast("double"), zero]
    if dtype.kind == "float":
        return [v.cast("double"), none, zero]
    return [none, none, as_signed(v) if dtype.name == "Uint64" else v.cast("bigint")]


def _unpacked(dtype: ScalarType) -> Column:
    if dtype.kind == "complex":
        return F.struct(F.col("x").alias("re"), F.col("y").alias("im")).cast(dtype.spark)
    return F.col("x") if dtype.kind == "float" else as_unsigned(F.col("w")) if dtype.name == "Uint64" else F.col("w")


def _used(dtype: ScalarType) -> str:
    """Those of x, y and w that hold a cell value."""
    return {"complex": "xy", "float": "x"}.get(dtype.kind, "w")


def _from_batch(batch: pa.RecordBatch, dtype: ScalarType) -> np.ndarray:
    x, *y = (batch.column(c).to_numpy(zero_copy_only=False) for c in _used(dtype))
    return (x + 1j * y[0] if dtype.kind == "complex" else x.view(np.uint64) if dtype.name == "Uint64" else x).astype(dtype.numpy)


def _to_columns(flat: np.ndarray, dtype: ScalarType, used: str) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {c: np.zeros(flat.size, np.int64 if c == "w" else np.float64) for c in used if c not in _used(dtype)}
    if dtype.kind == "complex":
        out |= {"x": flat.real.astype(np.float64), "y": flat.imag.astype(np.float64)}
    elif dtype.kind == "float":
        out["x"] = flat.astype(np.float64)
    else:
        out["w"] = flat.astype(np.uint64).view(np.int64) if dtype.name == "Uint64" else flat.astype(np.int64)
    return {c: out[c] for c in used}


def packed_cells(cells: DataFrame, array: ArrayFrame) -> DataFrame:
    """(chunk_id, at, v): cells (chunk_id, d0.., v), many to a row: their row-major places in the array, of which a run has the first only, and their values."""
    shape, dtype = tuple(array.shape), array.dtype

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            chunk, places, values = b.column("chunk_id").to_numpy(), np.zeros(b.num_rows, np.int64), _from_batch(b, dtype)
            for k, n in enumerate(shape):
                places = places * n + b.column(f"d{k}").to_numpy()
            order = np.lexsort((places, chunk))
            ids, at, v = [], [], []
            for rows in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                where = places[rows]
                ids.append(chunk[rows[0]])
                at.append((where[:1] if (np.diff(where) == 1).all() else where).tobytes())
                v.append(values[rows].tobytes())
            yield pa.record_batch({"chunk_id": pa.array(ids, pa.int64()), "at": pa.array(at, pa.binary()), "v": pa.array(v, pa.binary())})

    values = dict(zip("xyw", _packed(dtype, F.col("v")), strict=True))
    return cells.select("chunk_id", *array.columns, *(values[c].alias(c) for c in _used(dtype))).mapInArrow(pack, "chunk_id bigint, at binary, v binary")


def _place(data: np.ndarray, box: Bounds, shape: Sequence[int], at: bytes, v: bytes) -> None:
    """Puts packed cells, which lie in a box of an array of this shape, into the values of the box."""
    places, values = np.frombuffer(at, np.int64), np.frombuffer(v, data.dtype)
    if tuple(data.shape) == tuple(shape):  # the whole array
        data.reshape(-1)[slice(places[0], places[0] + len(values)) if len(places) == 1 else places] = values
        return
    if len(places) < len(values):
        places = places[0] + np.arange(len(values))
    data[tuple(i - r.begin for i, r in zip(np.unravel_index(places, shape), box, strict=True))] = values


def block_pairs(left: DataFrame, right: DataFrame, left_number: int, right_number: int, numbered: str | None = None) -> DataFrame:
    """Every pair (a_.., b_..) of the rows of two tables of about so many packed blocks each.

    Blocks are shuffled once and pairs are made as they are read, so the disk grows with the blocks and a task holds its part of one side.
    With the column that numbers the blocks of a table that meets itself, of each two pairs (x, y) and (y, x) only one is made, and every task
    makes about half of its pairs.
    """
    sides = []
    for side, blocks, number in (("a", left, left_number), ("b", right, right_number)):
        dealt = blocks.repartition(max(1, min(SIDE_PARTITIONS, -(-number // 3))))
        sides.append(dealt.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)))
    right = sides[1].hint("shuffle_replicate_nl")
    if numbered is None:
        return sides[0].crossJoin(right)
    x, y = F.col(f"a_{numbered}"), F.col(f"b_{numbered}")
    return sides[0].join(right, ((x <= y) & ((x + y) % 2 == 0)) | ((x > y) & ((x + y) % 2 != 0)))


def mirrored(shape: tuple[int, int], begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, image) of the places begin to end, if each row of a matrix is followed by its mirror image.

    So a row's values come twice running, of which a file with compressed pages holds the second time as a reference to the first.
    """
    row, image, column = np.unravel_index(np.arange(begin, end), (shape[0], 2, shape[1]))
    return row, column, image.astype(bool)


def _array_blocks(array: ArrayFrame) -> DataFrame:
    """(chunk, v): each chunk of an array as the bytes of its values."""
    grid, shape, kind = array.distribution, tuple(array.shape), array.dtype.numpy

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, data, box = 0, None, None
        for b in batches:
            for row in b.to_pylist():
                if data is None:
                    chunk, box = row["chunk_id"], grid.chunk_bounds(row["chunk_id"])
                    data = np.zeros([r.size for r in box], kind)
                if row["at"] is not None:
                    _place(data, box, shape, row["at"], row["v"])
        yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "v": pa.array([data.tobytes()], pa.binary())})

    cells = array.with_chunk_id()
    for c, n in zip(array.columns, shape, strict=True):
        cells = cells.where((F.col(c) >= 0) & (F.col(c) < n))
    none = F.lit(None).cast("binary")
    every = array.spark.range(grid.num_chunks).select(F.col("id").alias("chunk_id"), none.alias("at"), none.alias("v"))  # also those without cells
    return packed_cells(cells, array).union(every).groupBy("chunk_id").applyInArrow(dense, "chunk bigint, v binary")


def _mirrors(chunks: DataFrame, reads: list[tuple[int, Access]], targets: list[Access]) -> bool:
    """Whether a domain has the mirror image of every chunk, which reads the same two regions of one array and writes the mirrored region."""
    if len(reads) != 2 or len(targets) != 1 or targets[0].mode != "write" or targets[0].array.rank != 2:
        return False
    (_, a), (_, b) = reads
    axes = _plain_axes(targets[0].resolved())
    if axes is None or a.array is not b.array or len(set(targets[0].array.shape)) != 1:
        return False
    other = {axes[0]: axes[1], axes[1]: axes[0]}
    if a.clipped != b.clipped or [replace(m, axis=other.get(m.axis, m.axis)) for m in a.resolved()] != list(b.resolved()):
        return False
    geometry = chunks.select(*(f"{x}{k}" for k in range(AXES) for x in "os"))
    return geometry.exceptAll(geometry.select(*(F.col(f"{x}{other.get(k, k)}").alias(f"{x}{k}") for k in range(AXES) for x in "os"))).isEmpty()


def _chunk_pairs(chunks: DataFrame, reads: list[tuple[int, Access]], once: bool = False) -> DataFrame | None:
    """The work chunks, each with the two array chunks (a_v, b_v) that it reads, if they are at least half of all pairs of chunks of two arrays; else None.

    To gather the cells of such a domain would shuffle every chunk as often as the other array has chunks. once: of two chunks that mirror each
    other, and read different array chunks, only one.
    """
    if len(reads) != 2:
        return None
    arrays = [a.array for _, a in reads]
    grids = [a.distribution for a in arrays]
    pairs = grids[0].num_chunks * grids[1].num_chunks
    large = any(np.dtype(a.dtype.numpy).itemsize * prod(g.chunk) > BLOCK_BYTES for a, g in zip(arrays, grids, strict=True))
    if not 1 < pairs <= 2 * BROADCAST_CHUNKS or large or any(any(a.offset) for a in arrays):
        return None
    place, ready = F.lit(0).cast("bigint"), F.lit(True)
    wanted = chunks
    for side, (_, a), grid in zip("ab", reads, grids, strict=True):
        regions = _array_chunks(wanted, a, True)
        some = F.lit(True)
        for k in range(a.array.rank):
            some = some & (F.col(f"b{k}") < F.col(f"e{k}"))
        wanted = regions.withColumns({f"{side}_at": F.col("array_chunk"), f"{side}_some": some & F.col("array_chunk").between(0, grid.num_chunks - 1)})
        wanted = wanted.drop("array_chunk", *(f"{x}{k}" for k in range(a.array.rank) for x in "be"))
        place, ready = place * grid.num_chunks + F.col(f"{side}_at"), ready & F.col(f"{side}_some")
    found = wanted.agg(F.count("*").alias("n"), F.count_if(ready).alias("ready")).first()
    if found["n"] != found["ready"] or found["n"] > BROADCAST_CHUNKS or 2 * found["n"] < pairs:
        return None
    geometry = [f"{x}{k}" for k in range(AXES) for x in "os"]
    wanted = wanted.select(place.alias("pair"), *(F.col(c).alias(f"i{n}") for n, c in enumerate(geometry)))
    left = _array_blocks(arrays[0])
    right = left if arrays[1] is arrays[0] else _array_blocks(arrays[1])
    # the pair's number is made before the join, so that all blocks stay where they met
    met = block_pairs(left, right, grids[0].num_chunks, grids[1].num_chunks, "chunk" if once else None).withColumn("pair", F.col("a_chunk") * grids[1].num_chunks + F.col("b_chunk"))
    return met.join(F.broadcast(wanted), "pair").drop("pair")


def parallel_submit(spark: SparkSession, domain: object, kernel: ChunkKernel, target: Access, *args: object, strict: bool = True) -> ArrayFrame | tuple[ArrayFrame, ...]:
    """Runs a numpy kernel once for each chunk of a domain and writes (or reduces) what it returns into the targets' regions.

    The cells that a chunk reads are packed and gathered by its number, and come to it as a stream; so a chunk's regions, as numpy arrays, are
    what one task holds. Where the chunks are most pairs of the chunks of two arrays, these meet as blocks instead. Array arguments come as numpy arrays of their regions; an IndexMap among the arguments comes as the Range that it gives for the chunk. The first write of an array must
    cover it with regular chunks (written_chunks); later ones may write a part of it, but no cell twice. With several targets the kernel's
    output is kept (persisted), as each target reads it. A symmetric kernel is called once for two blocks that meet, and its values are written to both regions.
    """
    targets, rest, reads = _sorted_out(target, args)
    if any(a.array.dtype.kind == "pair" for a in (*targets, *(a for _, a in reads))):
        raise TypeError("chunk kernels take numbers")
    chunks = into_domain(spark, domain)
    for t in targets:
        if t.mode != "reduce" and not t.array.has_instance:
            grid = written_chunks(chunks, t)
            t.array.chunk_shape = t.array.chunk_shape or tuple(grid.chunk)
    given = {n: (a.resolved(), tuple(a.array.shape), a.clipped, a.array.dtype) for n, a in reads}
    plain = [None if n in given else a for n, a in enumerate(rest)]
    taken = [(t.private, t.resolved(), tuple(t.array.shape) if t.clipped else None, t.array.dtype) for t in targets]
    width, several = max([1, *(t.array.rank for t in targets)]), len(targets) > 1
    used = "".join(c for c in "xyw" if any(c in _used(t.array.dtype) for t in targets))
    f = kernel.f

    def called(begin: tuple[int, ...], size: tuple[int, ...], arrays: dict[int, np.ndarray], twice: bool = False) -> Iterator[pa.RecordBatch]:
        values = [arrays[n] if n in given else a.interval(begin[a.axis], size[a.axis]) if isinstance(a, IndexMap) else a for n, a in enumerate(plain)]
        got = f(Bounds.from_offset_size(begin, size), *values)
        for t, ((private, maps, shape, dtype), one) in enumerate(zip(taken, got if several else (got,), strict=True)):
            box = region(maps, begin, size, shape)
            lead = [r.size for r in region(private, begin, size)]
            made = np.broadcast_to(np.asarray(one), [*lead, *(r.size for r in box)])
            if twice:
                flat = np.repeat(made[:, None], 2, axis=1).reshape(-1)
                for k in range(0, flat.size, SLICE):
                    part = flat[k : k + SLICE]
                    row, column, image = mirrored(made.shape, k, k + part.size)
                    row, column = row + box[0].begin, column + box[1].begin
                    yield pa.record_batch({"d0": np.where(image, column, row), "d1": np.where(image, row, column)} | _to_columns(part, dtype, used))
                continue
            flat = made.reshape(-1)
            for k in range(0, flat.size, SLICE):
                part = flat[k : k + SLICE]
                index = np.unravel_index(np.arange(k, k + part.size), made.shape)[len(lead) :] if made.ndim else ()
                spots = {f"d{x}": i.astype(np.int64) + r.begin for x, (i, r) in enumerate(zip(index, box, strict=True))}
                spots |= {f"d{x}": np.zeros(part.size, np.int64) for x in range(len(box), width)}
                yield pa.record_batch(({"t": np.full(part.size, t, np.int32)} if several else {}) | spots | _to_columns(part, dtype, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One chunk: its geometry comes first, then packed cells of its regions."""
        begin, size, boxes, arrays = (), (), {}, {}
        for b in batches:
            columns = [b.column(c) for c in ("arg", "at", "v")]
            for k in range(b.num_rows):
                arg, at, v = (c[k].as_py() for c in columns)
                if arg < 0:
                    place = [b.column(f"i{x}")[k].as_py() for x in range(2 * AXES)]
                    begin, size = tuple(place[0::2]), tuple(place[1::2])
                    for n, (maps, shape, clipped, dtype) in given.items():
                        boxes[n] = region(maps, begin, size, shape if clipped else None)
                        arrays[n] = np.zeros([r.size for r in boxes[n]], dtype.numpy)
                else:
                    _place(arrays[arg], boxes[arg], given[arg][1], at, v)
        yield from called(begin, size, arrays)

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks whose regions lie in one block of each array."""
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                begin, size = (tuple(row[f"i{x}"] for x in range(s, 2 * AXES, 2)) for s in (0, 1))
                arrays = {}
                for side, (n, (maps, shape, clipped, dtype)) in zip("ab", given.items(), strict=True):
                    own, box = grids[n].chunk_bounds(row[f"{side}_chunk"]), region(maps, begin, size, shape if clipped else None)
                    block = np.frombuffer(row[f"{side}_v"], dtype.numpy).reshape([r.size for r in own])
                    arrays[n] = block[tuple(slice(r.begin - o.begin, r.end - o.begin) for r, o in zip(box, own, strict=True))].copy()
                yield from called(begin, size, arrays, once and row["a_chunk"] != row["b_chunk"])

    grids = {n: a.array.distribution for n, a in reads}
    schema = ", ".join([*["t int"] * several, *(f"d{k} bigint" for k in range(width)), *(f"{c} {'bigint' if c == 'w' else 'double'}" for c in used)])
    once = strict and kernel.symmetric and _mirrors(chunks, reads, targets)
    pairs = _chunk_pairs(chunks, reads, once) if strict else None
    if pairs is not None:
        made = pairs.mapInArrow(run_pairs, schema)
    else:
        geometry = [f"{x}{k}" for k in range(AXES) for x in "os"]
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
        rows = chunks.select("chunk_id", F.lit(-1).alias("arg"), *(F.col(c).alias(f"i{n}") for n, c in enumerate(geometry)), none.alias("at"), none.alias("v"))
        for n, a in reads:
            rows = rows.union(packed_cells(touched_cells(chunks, a, strict), a.array).select("chunk_id", F.lit(n), *[zero] * len(geometry), "at", "v"))
        made = rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "arg").groupBy("chunk_id").applyInArrow(run, schema)
    if len(targets) > 1:
        made = made.persist()
    for k, t in enumerate(targets):
        out = t.array
        mine = (made.where(F.col("t") == k) if len(targets) > 1 else made).select(*out.columns, _unpacked(out.dtype).alias("v"))
        if t.mode == "reduce":
            out.set(reduce_cells(mine, t.op or "sum", out.dtype, out.columns, index_space(spark, Bounds.of(out.shape)) if out.rank else None))
        elif out.has_instance:
            twice = F.raise_error(F.lit("two chunks write one cell"))
            once = mine.groupBy(*out.columns).agg(F.when(F.count("*") > 1, twice.cast(mine.schema["v"].dataType)).otherwise(F.first("v")).alias("v"))
            out.set(_replaced(out, once.select(*out.columns, F.col("v").cast(out.dtype.spark).alias("v"))))
        else:
            out.set(mine)
    return _results(targets)


def submit(spark: SparkSession, kernel: ChunkKernel, target: Access, *args: object) -> ArrayFrame | tuple[ArrayFrame, ...]:
    """One task over a single chunk; arrays without maps are touched as a whole."""
    return parallel_submit(spark, ([1], [1]), kernel, target, *args)


