"""The engine's workloads on tables, as queries (spark, sf_dir) -> DataFrame, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import scalar as S
from .functions.dtypes import REDUCTIONS, TYPES, identity, supports, wrap
from .operators.access import privatize, reduce, write
from .operators.arrayframe import ArrayFrame, index_space
from .operators.reduce import aggregate, arg_min, reduce_cells
from .operators.submit import ChunkKernel, ExprKernel, block_pairs, elementwise, mirrored, parallel_submit, reduce_elements, submit
from .plans.domain import Distribution, tile_domain
from .plans.mapper import ALL, ONE_TO_ONE, IndexMap, axis, span, tile
from .sources.host import allocate, from_table
from .streaming.events import Runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
I64, F64 = TYPES["Int64"], TYPES["Float64"]


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a rank-2 array: (d0 = vec_id, d1 = position, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "v")).select("d0", F.col("d1").cast("bigint").alias("d1"), "v")


def shape_of(cells: DataFrame, *coords: str) -> list[int]:
    """The smallest shape that holds all cells: the greatest coordinate of each axis plus one (0 without cells)."""
    return [0 if m is None else m + 1 for m in cells.agg(*(F.max(c) for c in coords)).first()]


def embedding_array(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """embeddings as a whole, in the shape that the table has."""
    cells = embedding_cells(spark, sf_dir)
    return from_table(cells, ["d0", "d1"], "v", shape_of(cells, "d0", "d1"), "Float32")


def cents() -> Column:
    """o_totalprice in whole cents, cut off."""
    return (F.col("o_totalprice") * 100).cast("bigint")


@query("SELECT o_orderkey // 1000 AS tile, CAST(sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1")
def reduce_sum_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of o_totalprice in cents for each tile of 1000 order keys."""
    rows = table(spark, sf_dir, "orders").select(S.div_floor(F.col("o_orderkey"), F.lit(1000)).alias("tile"), cents().alias("v"))
    return reduce_cells(rows, "sum", I64, ["tile"])


@query("SELECT l_linenumber AS d0, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def reduce_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("d0"))
    return rows.agg(aggregate("min", F.col("l_quantity"), F64).alias("lo"), aggregate("max", F.col("l_quantity"), F64).alias("hi"))


@query("SELECT l_linenumber AS d0, bit_and(l_partkey) AS all_bits, bit_or(l_partkey) AS any_bits FROM lineitem GROUP BY 1")
def reduce_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("d0"))
    return rows.agg(aggregate("bit_and", F.col("l_partkey"), I64).alias("all_bits"), aggregate("bit_or", F.col("l_partkey"), I64).alias("any_bits"))


@query("""SELECT d0, CAST(((s + 128) % 256 + 256) % 256 - 128 AS TINYINT) AS v
FROM (SELECT l_linenumber AS d0, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1)""")
def reduce_wrap_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("d0"), F.col("l_quantity").cast("tinyint").alias("v"))
    return reduce_cells(rows, "sum", "Int8", ["d0"])


@query("SELECT o_orderkey // 10 AS d0, product(CAST(o_orderkey % 3 + 1 AS DOUBLE)) AS v FROM orders GROUP BY 1")
def reduce_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(S.div_floor(F.col("o_orderkey"), F.lit(10)).alias("d0"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("v"))
    return reduce_cells(rows, "product", F64, ["d0"])


@query("SELECT o_orderkey // 10 AS d0, CAST(product(CAST(o_orderkey % 3 + 1 AS DOUBLE)) AS BIGINT) AS v FROM orders GROUP BY 1")
def reduce_product_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer products modulo 2**64."""
    rows = table(spark, sf_dir, "orders").select(S.div_floor(F.col("o_orderkey"), F.lit(10)).alias("d0"), (F.col("o_orderkey") % 3 + 1).alias("v"))
    return reduce_cells(rows, "product", I64, ["d0"])


@query("""SELECT b.d0, coalesce(n, 0) AS v FROM (SELECT CAST(range AS BIGINT) AS d0 FROM range(0, 12)) b
LEFT JOIN (SELECT CAST(l_linenumber AS BIGINT) AS d0, count(*) AS n FROM lineitem GROUP BY 1) c USING (d0)""")
def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram is a sum of ones; bins without rows hold the identity."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("d0"), F.lit(1).cast("bigint").alias("v"))
    return reduce_cells(rows, "sum", I64, ["d0"], index_space(spark, G.Bounds.of([12])))


@query("""SELECT b.d0, coalesce(n, 0) AS v FROM (SELECT CAST(range AS BIGINT) AS d0 FROM range(0, 64)) b
LEFT JOIN (SELECT CAST(least(greatest(floor((v + 4) * 8), 0), 63) AS BIGINT) AS d0, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1) c USING (d0)""")
def histogram_privatized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partial histogram for each image (vector), then one for all: two levels of the same reduction. The first and last bins take what lies beyond."""
    v = F.col("v").cast("double")
    bin_ = F.least(F.greatest(F.floor((v + 4) * 8), F.lit(0)), F.lit(63))
    rows = embedding_cells(spark, sf_dir).select(bin_.alias("d0"), F.col("d0").alias("p0"), F.lit(1).cast("bigint").alias("v"))
    return reduce_cells(rows, "sum", I64, ["d0"], index_space(spark, G.Bounds.of([64])), ["p0"])


@query("""SELECT d0, p.value AS value, p.key AS key FROM (SELECT o_custkey % 50 AS d0, min({'value': CAST(trunc(o_totalprice * 100) AS BIGINT), 'key': o_orderkey}) AS p FROM orders GROUP BY 1)""")
def argmin_keyvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("d0"), cents().alias("cents"), "o_orderkey")
    return arg_min(rows, ["d0"], "cents", "o_orderkey")


@query("""WITH s AS (SELECT max(vec_id) + 1 AS n, max(len(embedding)) AS m FROM embeddings)
SELECT vec_id + 100 AS d0, CAST(i + 42 AS BIGINT) AS d1, CAST(vec_id * m + i AS BIGINT) AS row_major, CAST(vec_id + i * n AS BIGINT) AS column_major, CAST(vec_id * 1000 + i * 3 AS BIGINT) AS strided
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i FROM embeddings), s""")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all cells of a view moved to (100, 42): row-major, column-major, and in a layout with strides of its own."""
    a = embedding_array(spark, sf_dir).shift_to(100, 42)
    return a.df.select("d0", "d1", *(a.linear_index(o).alias(n) for o, n in (("row", "row_major"), ("column", "column_major"), ([1000, 3], "strided"))))


@query("""WITH s AS (SELECT max(vec_id) + 1 AS n, max(len(embedding)) AS m FROM embeddings)
SELECT vec_id AS d0, CAST(i AS BIGINT) AS d1, CAST(vec_id * m + i AS BIGINT) AS row_major, CAST(vec_id + i * n AS BIGINT) AS column_major
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i FROM embeddings), s""")
def linear_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both linear indexes of every cell, with the strides of the table's own shape."""
    a = embedding_array(spark, sf_dir)
    return a.df.select("d0", "d1", a.linear_index("row").alias("row_major"), a.linear_index("column").alias("column_major"))


@query("SELECT CAST(i AS BIGINT) AS d0, v FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings WHERE vec_id = 7)")
def view_drop_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_array(spark, sf_dir).drop_axis(0, 7).df


@query("SELECT o_orderkey + 50 AS d0, CAST(trunc(o_totalprice * 100) AS BIGINT) AS v FROM orders")
def view_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of every order key, moved to start at 50."""
    orders = table(spark, sf_dir, "orders")
    return from_table(orders, ["o_orderkey"], cents(), shape_of(orders, "o_orderkey"), I64).shift_axis_to(0, 50).df


def _reduced(spark: SparkSession, sf_dir: str, kept: int) -> DataFrame:
    """Sums over one axis of the embeddings, in fixed point (8 decimals), as sums of floats depend on their order."""
    cells = embedding_cells(spark, sf_dir).select("d0", "d1", (F.col("v").cast("decimal(20,8)") * 100_000_000).cast("bigint").alias("v"))
    size = shape_of(cells, "d0", "d1")
    a, out, axes = from_table(cells, ["d0", "d1"], "v", size, I64), ArrayFrame(spark, [size[kept]], I64), [axis(0), axis(1)]
    reduce_elements(spark, size, ExprKernel(lambda d, v: v), reduce("sum", privatize(axes[1 - kept]), out[axes[kept]]), a[axes[0]][axes[1]])
    return out.df.select("d0", F.round(F.col("v").cast("decimal(30,0)") / F.lit(100_000_000).cast("decimal(10,0)"), 4).cast("double").alias("v"))


_EMBEDDED = "(SELECT vec_id AS d0, CAST(unnest(range(len(embedding))) AS BIGINT) AS d1, CAST(unnest(embedding) AS DECIMAL(20, 8)) AS v FROM embeddings)"


@query(f"SELECT d0, CAST(round(sum(v), 4) AS DOUBLE) AS v FROM {_EMBEDDED} GROUP BY 1")
def row_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, 0)


@query(f"SELECT d1 AS d0, CAST(round(sum(v), 4) AS DOUBLE) AS v FROM {_EMBEDDED} GROUP BY 1")
def col_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, 1)


@query("SELECT CAST(sum(l_orderkey) AS BIGINT) AS v FROM lineitem")
def total_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_cells(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v")), "sum", I64, [])


@query("""SELECT a.vec_id AS d0, b.vec_id AS d1, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS v
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS q FROM embeddings) a,
(SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS q FROM embeddings) b""")
def matmul_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of every two vectors, quantised to integers: a chunk kernel multiplies blocks of both sides, whose inner axis is whole, and writes.

    The product is symmetric, so blocks meet once and a row's values are written twice running, for (i, j) and for (j, i).
    """
    cells = embedding_cells(spark, sf_dir).select("d0", "d1", (F.col("v").cast("double") * 1000).cast("bigint").alias("v"))
    n, m = shape_of(cells, "d0", "d1")
    i, k, j = axis(0), axis(1), axis(2)
    block = max(256, -(-n // 500))

    def products(chunk: G.Bounds, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = max(1, m) * float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0))
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64) if most < 1 << 53 else x @ y.T  # sums that doubles hold exactly

    a, out = from_table(cells, ["d0", "d1"], "v", [n, m], I64, [block, max(1, m)]), ArrayFrame(spark, [n, n], I64)
    parallel_submit(spark, ([n, m, n], [block, max(1, m), block]), ChunkKernel(products, symmetric=True), write(out[i][j]), a[i][k], a[j][k])
    return out.df


@query("""SELECT a.vec_id AS d0, b.vec_id AS d1, round(list_dot_product(CAST(CAST(a.embedding AS DECIMAL(20, 8)[]) AS DOUBLE[]), CAST(CAST(b.embedding AS DECIMAL(20, 8)[]) AS DOUBLE[])), 4) + 0.0 AS v
FROM embeddings a, embeddings b""")
def matmul_gram_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of every two vectors of the table."""
    return gram(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("decimal(20,8)").cast("double")).alias("v")))


def gram(vectors: DataFrame, block: int = 256) -> DataFrame:
    """(d0, d1, v): the products of every two vectors (id, v), rounded to 4 places; null where a vector is null, an error if lengths differ.

    Vectors are packed into blocks, and numpy multiplies every two blocks: what is shuffled are the blocks, not the terms of the sums.
    Two blocks meet once, and a row's values are written twice running, for (i, j) and for (j, i).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for k in range(0, batch.num_rows, block):
                ids, v = batch.column("id").slice(k, block), batch.column("v").slice(k, block)
                rows, given = v.drop_null(), v.is_valid().to_numpy(zero_copy_only=False)
                width = len(rows.flatten()) // max(1, len(rows))
                if rows.flatten().null_count or not np.all(rows.value_lengths().to_numpy(zero_copy_only=False) == width):
                    raise ValueError("vectors must have the same length and no nulls")
                whole = np.zeros((len(ids), width))
                whole[given] = rows.flatten().to_numpy().reshape(len(rows), width)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                made += 1
                yield pa.record_batch({"block": pa.array([(part << 32) + made]), "ids": [ids.fill_null(0).to_numpy().tobytes()], "named": [named.tobytes()], "given": [given.tobytes()], "v": [whole.tobytes()]})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(row: dict, side: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            ids = pa.array(np.frombuffer(row[f"{side}_ids"], np.int64), mask=~np.frombuffer(row[f"{side}_named"], bool))
            return ids, np.frombuffer(row[f"{side}_given"], bool), np.frombuffer(row[f"{side}_v"]).reshape(len(ids), -1)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                (i, has_i, x), (j, has_j, y) = read(row, "a"), read(row, "b")
                if has_i.any() and has_j.any() and x.shape[1] != y.shape[1]:
                    raise ValueError("vectors must have the same length and no nulls")
                v = (x @ y.T if x.shape[1] == y.shape[1] else np.zeros((len(i), len(j)))) * 10_000
                v = np.copysign(np.floor(np.abs(v) + 0.5), v) / 10_000 + 0.0  # halves away from zero, no negative zero
                none = ~(has_i[:, None] & has_j)
                if row["a_block"] == row["b_block"]:
                    first, second = np.divmod(np.arange(v.size), len(j))
                    second = second + len(i)
                else:
                    at, to, image = mirrored(v.shape, 0, 2 * v.size)
                    first, second = np.where(image, to + len(i), at), np.where(image, at, to + len(i))
                    v, none = np.repeat(v, 2, axis=0), np.repeat(none, 2, axis=0)
                ids = pa.concat_arrays([i, j])
                yield pa.record_batch({"d0": ids.take(pa.array(first)), "d1": ids.take(pa.array(second)), "v": pa.array(v.reshape(-1), mask=none.reshape(-1) if none.any() else None)})

    number = vectors.count() // block + 1
    # dealt by their contents and sorted, so that both sides have the same blocks, however often and in whatever order vectors are read
    dealt = vectors.repartition(number // 16 + 1, "id", "v").sortWithinPartitions("id", "v").withColumn("part", F.spark_partition_id())
    packed = dealt.mapInArrow(pack, "block bigint, ids binary, named binary, given binary, v binary")
    return block_pairs(packed, packed, number, number, "block").mapInArrow(multiply, "d0 bigint, d1 bigint, v double")


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, CAST(sum((i * 7 + k) % 11 * ((k * 5 + j) % 13)) AS BIGINT) AS v
FROM range(0, 48) a(i), range(0, 40) b(k), range(0, 32) c(j) GROUP BY 1, 2""")
def matmul_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix multiplication over 3-d chunks: numpy multiplies blocks, the reduction adds them over the inner axis."""
    n, m, p = 48, 40, 32
    a, b, c = ArrayFrame(spark, [n, m], I64, [16, 20]), ArrayFrame(spark, [m, p], I64, [20, 16]), ArrayFrame(spark, [n, p], I64)
    elementwise(spark, [n, m], ExprKernel(lambda d: (d[0] * 7 + d[1]) % 11), write(a))
    elementwise(spark, [m, p], ExprKernel(lambda d: (d[0] * 5 + d[1]) % 13), write(b))
    i, k, j = axis(0), axis(1), axis(2)
    parallel_submit(spark, ([n, m, p], [16, 20, 16]), ChunkKernel(lambda chunk, x, y: x @ y), reduce("sum", c[i][j]), a[i][k], b[k][j])
    return c.df


_EDGES = [(0.0, 0.0), (8.0, 1.0), (9.5, 5.0), (6.0, 4.0), (8.5, 9.0), (5.0, 7.0), (3.0, 9.5), (2.5, 6.0), (-1.0, 8.0), (1.0, 4.5), (-2.0, 3.0), (1.5, 2.5)]


@query(f"""WITH pts AS (SELECT c_custkey, CAST(c_custkey * 37 % 101 AS DOUBLE) / 9 - 1 AS x, CAST(c_custkey * 53 % 97 AS DOUBLE) / 9 - 0.5 AS y FROM customer),
e AS (SELECT * FROM (VALUES {', '.join(f'({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)' for a, b in zip(_EDGES, _EDGES[1:] + _EDGES[:1]))}) t(x1, y1, x2, y2))
SELECT c_custkey AS d0, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS v FROM pts, e GROUP BY 1""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of crossings. The coordinates are two arrays; the polygon is a small array literal that each point folds over."""
    n = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    size = shape_of(customer, "c_custkey")
    xs = from_table(customer, ["c_custkey"], (n * 37 % 101).cast("double") / 9 - 1, size, F64)
    ys = from_table(customer, ["c_custkey"], (n * 53 % 97).cast("double") / 9 - 0.5, size, F64)
    edges = F.array(*(F.struct(F.lit(a[0]).alias("x1"), F.lit(a[1]).alias("y1"), F.lit(b[0]).alias("x2"), F.lit(b[1]).alias("y2")) for a, b in zip(_EDGES, _EDGES[1:] + _EDGES[:1], strict=True)))

    def inside(d: list[Column], x: Column, y: Column) -> Column:
        crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y1"] != e["y2"], x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)
        return (F.size(F.filter(edges, crosses)) % 2).cast("tinyint")

    out, i = ArrayFrame(spark, size, "Int8"), axis(0)
    elementwise(spark, size, ExprKernel(inside), write(out[i]), xs[i], ys[i])
    return out.df.select("d0", (F.col("v") == 1).alias("v"))


def _part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.range_struct(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")).alias("r"))


@query("""SELECT p.d0, count(b.p_partkey) AS v FROM (SELECT unnest(range(0, (SELECT max(p_partkey) + 1 FROM part))) AS d0) p
LEFT JOIN part a ON a.p_partkey = p.d0 LEFT JOIN part b ON a.p_partkey <> b.p_partkey AND a.p_size > 0 AND b.p_size > 0
AND a.p_partkey < b.p_partkey + b.p_size AND b.p_partkey < a.p_partkey + a.p_size GROUP BY 1""")
def bounds_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many others the range of each part overlaps, as a dense array: a sum of ones for both sides of each pair."""
    ranges = _part_ranges(spark, sf_dir)
    pairs = overlapping(ranges)
    ones = pairs.select(F.explode(F.array("a", "b")).alias("d0"), F.lit(1).cast("bigint").alias("v"))
    return reduce_cells(ones, "sum", I64, ["d0"], index_space(spark, G.Bounds.of(shape_of(ranges, "p_partkey"))))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size > 0 AND b.p_size > 0
AND a.p_partkey < b.p_partkey + b.p_size AND b.p_partkey < a.p_partkey + a.p_size""")
def bounds_overlaps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of every part against each other."""
    return overlapping(_part_ranges(spark, sf_dir))


def overlapping(r: DataFrame) -> DataFrame:
    """An interval join: ranges are cut at multiples of 64, so that those that overlap share a cell, which is the equi-join key."""
    cell = 64
    cells = r.where(~G.range_is_empty(F.col("r"))).withColumn("cell", F.explode(F.sequence(S.div_floor(F.col("r.begin"), F.lit(cell)), S.div_floor(F.col("r.end") - 1, F.lit(cell)))))
    a, b = cells.alias("a"), cells.alias("b")
    meet = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.p_partkey") < F.col("b.p_partkey")) & G.range_overlaps(F.col("a.r"), F.col("b.r"))
    first = S.div_floor(F.greatest(F.col("a.r.begin"), F.col("b.r.begin")), F.lit(cell)) == F.col("a.cell")
    return a.join(b, meet & first).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    a = F.array(G.range_struct(k % 17, k % 17 + s % 9), G.range_struct(s % 5, F.lit(7)))
    b = F.array(G.range_struct(F.lit(4), F.lit(12)), G.range_struct(F.lit(2), F.lit(6)))
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))


@query("""SELECT p_partkey, CAST(least(p_partkey % 17, 4) AS BIGINT) AS b0, CAST(greatest(p_partkey % 17 + p_size % 9, 12) AS BIGINT) AS e0,
CAST(least(p_size % 5, 2) AS BIGINT) AS b1, CAST(greatest(7, 6) AS BIGINT) AS e1 FROM part""")
def bounds_unite(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _boxes(spark, sf_dir).select("p_partkey", G.bounds_unite(F.col("a"), F.col("b")).alias("u"))
    return u.select("p_partkey", F.expr("u[0].begin").alias("b0"), F.expr("u[0].end").alias("e0"), F.expr("u[1].begin").alias("b1"), F.expr("u[1].end").alias("e1"))


@query("""SELECT p_partkey, CAST(greatest(p_partkey % 17, 4) AS BIGINT) AS b0, CAST(least(p_partkey % 17 + p_size % 9, 12) AS BIGINT) AS e0,
CAST(greatest(p_size % 5, 2) AS BIGINT) AS b1, CAST(6 AS BIGINT) AS e1,
CAST(greatest(least(p_partkey % 17 + p_size % 9, 12) - greatest(p_partkey % 17, 4), 0) * greatest(6 - greatest(p_size % 5, 2), 0) AS BIGINT) AS volume,
p_size % 9 > 0 AND p_partkey % 17 < 12 AND 4 < p_partkey % 17 + p_size % 9 AS overlaps FROM part""")
def bounds_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("p_partkey", G.bounds_intersection(F.col("a"), F.col("b")).alias("u"), G.bounds_overlaps(F.col("a"), F.col("b")).alias("overlaps"))
    return rows.select("p_partkey", F.expr("u[0].begin").alias("b0"), F.expr("u[0].end").alias("e0"), F.expr("u[1].begin").alias("b1"), F.expr("u[1].end").alias("e1"), G.bounds_volume(F.col("u")).alias("volume"), "overlaps")


@query("""SELECT CAST(i AS BIGINT) AS chunk_id, CAST(i % 3 AS INT) AS owner, CAST(i % 7 * 15 AS BIGINT) AS o0, CAST(i // 7 % 4 * 8 AS BIGINT) AS o1, CAST(i // 28 * 5 AS BIGINT) AS o2,
CAST(least(15, 100 - i % 7 * 15) AS BIGINT) AS s0, CAST(least(8, 30 - i // 7 % 4 * 8) AS BIGINT) AS s1, CAST(least(5, 9 - i // 28 * 5) AS BIGINT) AS s2 FROM range(0, 56) t(i)""")
def tile_domain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_domain(spark, [100, 30, 9], [15, 8, 5], owners=3)


@query("""SELECT vec_id // 15 * 7 + i // 10 AS chunk_id, count(*) AS cells FROM (SELECT vec_id, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1""")
def distribution_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of the embeddings lie in each chunk of 15 x 10."""
    cells = embedding_cells(spark, sf_dir)
    grid = Distribution(shape_of(cells, "d0", "d1"), [15, 10])
    return cells.groupBy(grid.chunk_id([F.col("d0"), F.col("d1")]).alias("chunk_id")).agg(F.count("*").alias("cells"))


@query("""SELECT CAST(i AS BIGINT) AS chunk_id, CAST(i // 3 * 15 AS BIGINT) AS o0, CAST(i % 3 * 10 AS BIGINT) AS o1,
CAST(least(15, 29 - i // 3 * 15) AS BIGINT) AS s0, CAST(least(10, 27 - i % 3 * 10) AS BIGINT) AS s1 FROM range(0, 6) t(i)""")
def distribution_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Distribution([29, 27], [15, 10]).table(spark)


@query("""WITH c AS (SELECT o_orderkey, o_orderkey * 3 % 200 - 100 AS a0, 1 + o_orderkey % 9 AS n FROM orders),
m AS (SELECT *, -2 * (a0 + n - 1) + 3 AS b0, 2 * (n - 1) + 4 AS bn FROM c)
SELECT o_orderkey, CAST(b0 // 3 AS BIGINT) AS b, CAST(b0 // 3 + (bn + b0 % 3 + 2) // 3 AS BIGINT) AS e FROM m""")
def indexmap_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map (-2 x + 3 + [0, 4)) / 3 of chunks along one axis."""
    k = F.col("o_orderkey")
    b, e = IndexMap(0, -2, 3, 4, 3).apply(k * 3 % 200 - 100, 1 + k % 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", b.alias("b"), e.alias("e"))


@query("""SELECT o_orderkey, CAST(floor((o_orderkey - 500) / 7.0) AS BIGINT) AS down, CAST(ceil((o_orderkey - 500) / 7.0) AS BIGINT) AS up,
CAST(ceil((o_orderkey - 500) / 7.0) * 7 AS BIGINT) AS multiple, CAST(floor((o_orderkey - 500) / -7.0) AS BIGINT) AS down_neg FROM orders""")
def integer_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderkey") - 500
    return table(spark, sf_dir, "orders").select("o_orderkey", S.div_floor(a, F.lit(7)).alias("down"), S.div_ceil(a, F.lit(7)).alias("up"), S.round_up_to_multiple(a, F.lit(-7)).alias("multiple"), S.div_floor(a, F.lit(-7)).alias("down_neg"))


@query("""SELECT o_orderkey, o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0 AS is_power,
CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(2 ** ceil(log2(o_orderkey)) AS BIGINT) END AS up FROM orders""")
def pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_power_of_two(k).alias("is_power"), S.round_up_to_power_of_two(k).alias("up"))


@query("""SELECT p_partkey, TRY_CAST(p_size + 100 AS TINYINT) AS added, TRY_CAST(p_size * p_partkey AS SMALLINT) AS multiplied,
TRY_CAST(p_partkey AS TINYINT) IS NOT NULL AS fits, p_retailprice = trunc(p_retailprice) AND p_retailprice BETWEEN -32768 AND 32767 AS whole FROM part""")
def checked_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where checked arithmetic raises; and lossless conversion."""
    k, s, i8, i16 = F.col("p_partkey"), F.col("p_size"), TYPES["Int8"], TYPES["Int16"]
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.tried(s + 100, i8).alias("added"), S.tried(s * k, i16).alias("multiplied"),
        S.is_convertible(k, "int", i8).alias("fits"), S.is_convertible(F.col("p_retailprice"), "float", i16).alias("whole"))


@query("SELECT o_orderkey AS d0, CAST(trunc(o_totalprice * 100) AS BIGINT) + o_custkey AS v FROM orders")
def vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C = A + B of two arrays of one shape."""
    orders = table(spark, sf_dir, "orders")
    n, x = shape_of(orders, "o_orderkey"), axis(0)
    a, b, c = from_table(orders, ["o_orderkey"], cents(), n, I64), from_table(orders, ["o_orderkey"], "o_custkey", n, I64), ArrayFrame(spark, n, I64)
    return elementwise(spark, n, ExprKernel(lambda d, u, v: u + v), write(c[x]), a[x], b[x]).df


@query("SELECT c_custkey AS d0, CAST(trunc(c_acctbal * 100) AS BIGINT) + 3 * c_custkey AS v FROM customer")
def vector_add_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of every customer plus three times an array of places that no table holds; they meet by their coordinate."""
    customer = table(spark, sf_dir, "customer")
    n, x = shape_of(customer, "c_custkey"), axis(0)
    a, b, c = from_table(customer, ["c_custkey"], (F.col("c_acctbal") * 100).cast("bigint"), n, I64), ArrayFrame(spark, n, I64).iota(), ArrayFrame(spark, n, I64)
    return elementwise(spark, n, ExprKernel(lambda d, u, v, k: u + v * k), write(c[x]), a[x], b[x], 3).df


@query("SELECT o_orderkey AS d0, CAST(trunc(o_totalprice * 100) AS BIGINT) + o_orderkey AS v FROM orders")
def vector_add_zip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, in an array as long as the keys go."""
    orders = table(spark, sf_dir, "orders")
    return zipped(orders, *shape_of(orders, "o_orderkey"))


def zipped(orders: DataFrame, n: int) -> DataFrame:
    """C = A + B of separate arrays, which meet by their coordinate."""
    spark = orders.sparkSession
    a = from_table(orders, ["o_orderkey"], cents(), [n], I64)
    b, c = ArrayFrame(spark, [n], I64).iota(), ArrayFrame(spark, [n], I64)
    x = axis(0)
    return elementwise(spark, [n], ExprKernel(lambda d, u, v: u + v), write(c[x]), a[x], b[x]).df


@query("SELECT CAST(i // 20 AS BIGINT) AS d0, CAST(i % 20 AS BIGINT) AS d1, CAST(i AS BIGINT) AS iota, CAST(7 AS BIGINT) AS seven FROM range(0, 600) t(i)")
def fill_iota(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ArrayFrame(spark, [30, 20], I64).iota(), ArrayFrame(spark, [30, 20], I64).fill(7)
    return a.df.withColumnRenamed("v", "iota").join(b.df.withColumnRenamed("v", "seven"), ["d0", "d1"])


@query("""SELECT CAST(i AS BIGINT) AS d0, CASE WHEN i >= 5 AND i < 5 + 40 * 2 AND (i - 5) % 2 = 0 THEN 10 + (i - 5) // 2 * 3 ELSE -1 END AS v FROM range(0, 100) t(i)""")
def copy_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 cells from 10 on, every third, to 5 on, every second."""
    source, out = ArrayFrame(spark, [200], I64).iota(), ArrayFrame(spark, [100], I64).fill(-1)
    return out.copy_region(source, [10], [5], [40], [3], [2]).df


@dataclass
class Scaled:
    """Arguments that belong together: two arrays, a factor, and where the result goes."""

    size: object
    key: object
    factor: float
    target: object


@query("""SELECT p_partkey AS d0, CAST(p_size * 2.5 + p_partkey AS DOUBLE) AS v, CAST(p_size - p_partkey AS BIGINT) AS w FROM part""")
def struct_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataclass among the arguments: its arrays are read, its factor is passed on, and its target is written."""
    part = table(spark, sf_dir, "part")
    n, x = shape_of(part, "p_partkey"), axis(0)
    a, b = (from_table(part, ["p_partkey"], c, n, I64) for c in ("p_size", "p_partkey"))
    v, w = ArrayFrame(spark, n, F64), ArrayFrame(spark, n, I64)
    given = Scaled(a[x], b[x], 2.5, write(w[x]))
    elementwise(spark, n, ExprKernel(lambda d, size, key, factor: (size * factor + key, size - key)), write(v[x]), given)
    return v.df.join(w.df.withColumnRenamed("v", "w"), "d0")


@query("SELECT CAST(l_linenumber AS BIGINT) AS d0, CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def tile_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of tiles of 37 orders, then of all: the same as in one step."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("d0"), S.div_floor(F.col("l_orderkey"), F.lit(37)).alias("p0"), F.col("l_partkey").alias("v"))
    return reduce_cells(rows, "sum", I64, ["d0"], private=["p0"])


@query("SELECT CAST(i AS BIGINT) AS d0, CAST(sum(i + 2 * j) AS BIGINT) AS v FROM range(0, 50) a(i), range(0, 40) b(j) GROUP BY 1")
def reduce_privatized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reduce(sum, privatize(j), rows[i]) of v(i, j) = i + 2 j."""
    n, m = 50, 40
    matrix, rows = ArrayFrame(spark, [n, m], I64), ArrayFrame(spark, [n], I64)
    i, j = axis(0), axis(1)
    elementwise(spark, [n, m], ExprKernel(lambda d: d[0] + d[1] * 2), write(matrix[i][j]))
    return reduce_elements(spark, [n, m], ExprKernel(lambda d, v: v), reduce("sum", privatize(j), rows[i]), matrix[i][j]).df


@query("SELECT CAST(i AS BIGINT) AS d0, CAST(3 * i + CASE WHEN i > 0 THEN i - 1 ELSE 0 END + CASE WHEN i < 99 THEN i + 1 ELSE 0 END - 2 * i AS BIGINT) AS v FROM range(0, 100) t(i)")
def stencil_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours across chunk edges: a region join with halos (strict reads would raise)."""
    a, b = ArrayFrame(spark, [100], I64, [10]).iota(), ArrayFrame(spark, [100], I64)
    x = axis(0)

    def kernel(chunk, v):  # noqa: ANN001, ANN202
        import numpy as np

        n, missing = chunk[0].size, int(chunk[0].begin == 0)  # there is no left neighbour of the first cell
        wide = np.zeros(n + 2, v.dtype)
        wide[missing : missing + len(v)] = v
        return wide[:n] + wide[1 : n + 1] + wide[2 : n + 2]

    return parallel_submit(spark, ([100], [10]), ChunkKernel(kernel), write(b[x]), a[span(x - 1, x + 1)], strict=False).df


@query("""SELECT l_orderkey AS d0, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem""")
def scatter_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within ragged rows, as needed to make an array of contributions."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d0"), "l_linenumber", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, CAST(i * 3 + j AS BIGINT) AS v FROM range(0, 40) a(i), range(0, 25) b(j)""")
def allocate_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host memory to an array and back, in every form: typed values, bytes, and flat values with a shape."""
    import numpy as np

    data = np.arange(40)[:, None] * 3 + np.arange(25)
    a = allocate(spark, data, "Int64")
    b = ArrayFrame(spark, [40, 25], I64).copy_bytes_from(a.copy_bytes_to())
    return allocate(spark, b.copy_to_vector(), "Int64", [40, 25]).df


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 50 AS a0, 1 + o_orderkey % 9 AS n FROM orders)
SELECT k AS o_orderkey, -6 * (a0 + n - 1) - 15 AS scaled_b, -6 * a0 - 15 + 7 AS scaled_e, a0 // 4 AS divided_b, a0 // 4 + (n + a0 % 4 + 3) // 4 AS divided_e,
CAST(3 AS BIGINT) AS constant_b, CAST(8 AS BIGINT) AS constant_e, 5 * a0 AS tile_b, 5 * (a0 + n) AS tile_e FROM c""")
def indexmap_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, quotients, constant ranges and tiles of maps over the chunks [k mod 50, k mod 50 + 1 + k mod 9)."""
    x, k = axis(0), F.col("o_orderkey")
    maps = {"scaled": span(2 * x + 3, 2 * x + 5) * -3, "divided": x / 4, "constant": span(3, 8), "tile": tile(5)[0]}
    ends = {f"{n}_{e}": c for n, m in maps.items() for e, c in zip("be", m.apply(k % 50, 1 + k % 9), strict=True)}
    # 2x + 3 + [0, 3) times -3 is -6x - 15 + [0, 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in ends.items()))


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(2 * i + 1 + 1000 * (i // 3) + 7 AS BIGINT) AS v FROM range(0, 30) t(i)""")
def affine_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element-wise kernel that reads one array at 2x + 1, one at x / 3 and one at a constant place."""
    x = axis(0)
    a, b, c, out = (ArrayFrame(spark, [n], I64) for n in (60, 10, 9, 30))
    a.iota()
    b.iota()
    c.iota()
    return elementwise(spark, [30], ExprKernel(lambda d, u, v, w: u + v * 1000 + w), write(out[x]), a[2 * x + 1], b[x / 3], c[7]).df


@query("""SELECT CAST(i AS BIGINT) AS d0, CASE WHEN i % 2 = 1 AND i < 41 THEN 100 + i // 2 ELSE -1 END AS v FROM range(0, 50) t(i)""")
def affine_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second cell of a filled array is written, at 2x + 1."""
    x, out = axis(0), ArrayFrame(spark, [50], I64).fill(-1)
    return elementwise(spark, [20], ExprKernel(lambda d: d[0] + 100), write(out[2 * x + 1])).df


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(sum(i * 7 + j * 5) AS BIGINT) AS total, CAST(max((i * 7 + j * 5) % 13) AS BIGINT) AS top FROM range(0, 48) a(i), range(0, 40) b(j) GROUP BY 1""")
def several_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission with two reductions, to different arrays and with different operations; the second has a private axis."""
    i, j = axis(0), axis(1)
    m, total, top = ArrayFrame(spark, [48, 40], I64, [16, 10]), ArrayFrame(spark, [48], I64), ArrayFrame(spark, [48], I64)
    elementwise(spark, [48, 40], ExprKernel(lambda d: d[0] * 7 + d[1] * 5), write(m[i][j]))
    kernel = ChunkKernel(lambda chunk, v: (v.sum(1), (v % 13).T))
    parallel_submit(spark, ([48, 40], [16, 10]), kernel, reduce("sum", total[i]), reduce("max", privatize(j), top[i]), m[i][j])
    return total.df.withColumnRenamed("v", "total").join(top.df.withColumnRenamed("v", "top"), "d0")


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(18446744073709551615 - i * i AS DECIMAL(20, 0)) AS v FROM (SELECT CAST(range AS HUGEINT) AS i FROM range(0, 64))""")
def unsigned_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned 64-bit cells through a chunk kernel."""
    import numpy as np

    x, a, out = axis(0), ArrayFrame(spark, [64], I64, [16]).iota(), ArrayFrame(spark, [64], "Uint64")
    return parallel_submit(spark, ([64], [16]), ChunkKernel(lambda c, v: np.uint64(2**64 - 1) - v.astype(np.uint64) ** 2), write(out[x]), a[x]).df


@query("""SELECT CAST(i AS BIGINT) AS chunk_id, CAST(i // 3 * 16 AS BIGINT) AS o0, CAST(i % 3 * 14 AS BIGINT) AS o1, CAST(16 AS BIGINT) AS s0, CAST(least(14, 40 - i % 3 * 14) AS BIGINT) AS s1 FROM range(0, 9) t(i)""")
def first_write_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution that the chunks of a domain give the array which they write first: checked for alignment, sizes, cover and duplicates."""
    x, y, out = axis(0), axis(1), ArrayFrame(spark, [48, 40], I64)
    parallel_submit(spark, ([48, 40], [16, 14]), ChunkKernel(lambda c: 1), write(out[x][y]))
    return out.distribution.table(spark)


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey * 12297829382938 + 18000000000000000000::HUGEINT AS a, CAST(c_nationkey AS HUGEINT) * 446744073709551 AS b, CAST(c_custkey AS HUGEINT) * 61489146912 AS f FROM customer)
SELECT k AS c_custkey, TRY_CAST(a + b AS UBIGINT)::DECIMAL(20, 0) AS added, TRY_CAST(b - f AS UBIGINT)::DECIMAL(20, 0) AS less, TRY_CAST(b * f AS UBIGINT)::DECIMAL(20, 0) AS multiplied FROM s""")
def checked_u64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences and products of unsigned 64-bit numbers; null where the checked forms raise."""
    k, u64 = F.col("c_custkey"), TYPES["Uint64"]
    big = lambda text: F.lit(text).cast("decimal(20,0)")
    a = k.cast("decimal(10,0)") * F.lit("12297829382938").cast("decimal(14,0)") + big("18000000000000000000")
    b = (F.col("c_nationkey").cast("decimal(4,0)") * F.lit("446744073709551").cast("decimal(15,0)")).cast("decimal(20,0)")
    f = (k.cast("decimal(8,0)") * F.lit("61489146912").cast("decimal(11,0)")).cast("decimal(20,0)")
    tried = {"added": S.tried(a + b, u64), "less": S.tried(b - f, u64), "multiplied": S.tried(S.product(b, f), u64)}
    return table(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in tried.items()))


@query("""SELECT l_returnflag AS flag, CAST(1000 + sum(l_partkey) AS BIGINT) AS total, CAST(7 * pow(2, count(*) FILTER (l_quantity >= 50 AND l_linenumber = 7) % 20) AS BIGINT) AS multiplied FROM lineitem GROUP BY 1""")
def checked_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked sum and a checked product, each from an initial value."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    twos = F.count(F.when((F.col("l_quantity") >= 50) & (F.col("l_linenumber") == 7), 1)) % 20
    out = rows.agg(S.checked_sum(F.col("l_partkey"), I64, 1000).alias("total"), twos.cast("int").alias("n"))
    return out.select("flag", "total", S.checked_fold_product(F.array_repeat(F.lit(2).cast("bigint"), F.col("n")), I64, 7).alias("multiplied"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) < o_totalprice AS lt, o_orderkey % 7 - 3 < o_custkey % 5 AS signed_lt, o_totalprice > o_custkey AS gt, o_totalprice >= o_custkey AS ge, o_orderkey = CAST(o_orderkey AS DOUBLE) AS eq, o_orderkey % 7 - 3 BETWEEN 0 AND 2 AS inside,
TRY_CAST(o_orderkey AS SMALLINT) AS small FROM orders""")
def exact_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons across types, ranges and lossless casts, on every order."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    i16 = TYPES["Int16"]
    cast = F.when(S.is_convertible(k, "int", i16), S.checked_cast(F.when(S.is_convertible(k, "int", i16), k).otherwise(0), "int", i16))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.is_less(k, "int", p, "float").alias("lt"), S.is_less(k % 7 - 3, "int", c % 5, "int").alias("signed_lt"), S.is_greater(p, "float", c, "int").alias("gt"),
        S.is_greater_equal(p, "float", c, "int").alias("ge"), S.is_equal(k, "int", k.cast("double"), "float").alias("eq"), S.in_range(k % 7 - 3, "int", F.lit(3)).alias("inside"), cast.alias("small"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 20 AS b, p_partkey % 20 + p_size % 11 - 2 AS e, p_size % 25 AS m FROM part)
SELECT p_partkey, b >= e AS empty, greatest(e - b, 0) AS size, m >= b AND m < e AS has, b >= e OR (b >= 3 AND e <= 24) AS inside, least(greatest(m, b), greatest(b, e)) AS cut, b + 5 AS moved_b, e + 5 AS moved_e FROM r""")
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptiness, size, containment, splitting and shifting of ranges, inverted ones too."""
    k, s = F.col("p_partkey"), F.col("p_size")
    r, m = G.range_struct(k % 20, k % 20 + s % 11 - 2), (s % 25).cast("bigint")
    head, tail = G.range_split(r, m)
    moved = G.range_shift(r, F.lit(5))
    wide = G.range_struct(F.lit(3), F.lit(24))
    return table(spark, sf_dir, "part").select(
        "p_partkey", G.range_is_empty(r).alias("empty"), G.range_size(r).alias("size"), G.range_contains(r, m).alias("has"), G.range_contains_range(wide, r).alias("inside"),
        F.when(head["end"] == tail["begin"], head["end"]).alias("cut"), moved["begin"].alias("moved_b"), moved["end"].alias("moved_e"))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 17 AS b0, p_partkey % 17 + p_size % 9 AS e0, p_size % 5 AS b1 FROM part)
SELECT p_partkey, CAST(greatest(e0 - b0, 0) * (7 - b1) AS BIGINT) AS volume, b0 >= e0 OR (b0 >= 0 AND e0 <= 20 AND b1 >= 0) AS inside, CAST(0 AS BIGINT) AS missing_begin, CAST(1 AS BIGINT) AS missing_end FROM b""")
def bounds_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes, containment and missing axes of boxes."""
    boxes = _boxes(spark, sf_dir)
    a, wide = F.col("a"), F.array(G.range_struct(F.lit(0), F.lit(20)), G.range_struct(F.lit(0), F.lit(9)))
    third = G.bounds_axis(a, 2)
    return boxes.select("p_partkey", G.bounds_volume(a).alias("volume"), G.bounds_contains(wide, a).alias("inside"), third["begin"].alias("missing_begin"), third["end"].alias("missing_end"))


@query("""WITH s AS (SELECT max(vec_id) + 1 AS n FROM embeddings)
SELECT n, CAST(64 AS BIGINT) AS m, CAST(sum(CAST(trunc(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS total FROM (SELECT unnest(embedding) AS v FROM embeddings), s GROUP BY n""")
def whole_array_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of a domain reads a whole array (All), and a rank-0 array takes the sum of what they make of it."""
    cells = embedding_cells(spark, sf_dir).select("d0", "d1", (F.col("v").cast("double") * 1000).cast("bigint").alias("v"))
    n, m = shape_of(cells, "d0", "d1")
    a, total, x = from_table(cells, ["d0", "d1"], "v", [n, m], I64), ArrayFrame(spark, [], I64), axis(0)
    # each of the four chunks adds the rows that are its own
    parallel_submit(spark, ([n], [max(1, -(-n // 4))]), ChunkKernel(lambda chunk, v, mine: v[mine.begin : mine.end].sum()), reduce("sum", total), a[ALL], x)
    return total.df.select(F.lit(n).cast("bigint").alias("n"), F.lit(m).cast("bigint").alias("m"), F.col("v").alias("total"))


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, i * 6 + j AS v, i * 6 + j = 9 AS nine FROM range(2, 5) a(i), range(1, 5) b(j)""")
def view_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of an array, with its bounds as a column test."""
    a = ArrayFrame(spark, [6, 6], I64).iota().slice(G.Bounds.of([(2, 5), (1, 5)]))
    return a.df.where(a.in_bounds(F.col("d0"), F.col("d1"))).select("d0", "d1", "v", (F.col("v") == 9).alias("nine"))


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(i * i AS BIGINT) AS v FROM range(0, 45) t(i)""")
def one_to_one_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an array meet the chunks of the domain of the same shape (one_to_one)."""
    a, out, x = ArrayFrame(spark, [45], I64, [10]).iota(), ArrayFrame(spark, [45], I64), axis(0)
    return parallel_submit(spark, ([45], [10]), ChunkKernel(lambda chunk, v: v * v), write(out[x]), a[ONE_TO_ONE]).df


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(i * 3 + 5 AS BIGINT) AS v FROM range(0, 12) t(i)""")
def submit_one_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single task over a whole array, with a scalar argument."""
    a, out = ArrayFrame(spark, [12], I64).iota(), ArrayFrame(spark, [12], I64)
    return submit(spark, ChunkKernel(lambda chunk, v, k: v * 3 + k), write(out), a, 5).df


@query("""SELECT CAST(0 AS BIGINT) AS d0, CAST(10 AS BIGINT) AS v UNION ALL SELECT 1, 35 UNION ALL SELECT 2, 0""")
def explicit_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain of the caller's own chunks, of different sizes, reduced into bins; the third bin holds the identity."""
    chunks = [(0, 0, 0, 5), (1, 0, 5, 5)]
    rows = spark.createDataFrame([(n, owner, o, 0, 0, s, 1, 1) for n, owner, o, s in chunks], "chunk_id long, owner int, o0 long, o1 long, o2 long, s0 long, s1 long, s2 long")
    a, out, x = ArrayFrame(spark, [10], I64, [5]).iota(), ArrayFrame(spark, [3], I64), axis(0)
    return parallel_submit(spark, rows, ChunkKernel(lambda chunk, v: v.sum()), reduce("sum", out[x / 5]), a[x]).df


@query("""SELECT CAST(i AS BIGINT) AS chunk_id, CAST(i // 2 * 4 AS BIGINT) AS o0, CAST(i % 2 * 3 AS BIGINT) AS o1, CAST(least(4, 10 - i // 2 * 4) AS BIGINT) AS s0, CAST(least(3, 5 - i % 2 * 3) AS BIGINT) AS s1,
CAST(CASE WHEN i = 3 THEN -1 ELSE i % 2 END AS INT) AS owner FROM range(0, 6) t(i)""")
def distribution_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution from chunks in any order; two owners of one place leave it to the host (-1)."""
    places = [(o, p) for o in (0, 4, 8) for p in (0, 3)]
    chunks = [(k % 2, place, (min(4, 10 - place[0]), min(3, 5 - place[1]))) for k, place in reversed(list(enumerate(places)))]
    grid = Distribution.from_chunks([10, 5], [*chunks, (0, (4, 3), (4, 2))], allow_duplicates=True)
    owners = spark.createDataFrame(list(enumerate(grid.owners or ())), "chunk_id long, owner int")
    return grid.table(spark).join(owners, "chunk_id")


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(greatest(0, 2 * (i // 8 * 8) - 3) AS BIGINT) AS v FROM range(0, 40) t(i)""")
def map_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index map as an argument: the kernel gets the range that it gives for its chunk."""
    x, out = axis(0), ArrayFrame(spark, [40], I64)
    return parallel_submit(spark, ([40], [8]), ChunkKernel(lambda chunk, r: max(0, r.begin)), write(out[x]), 2 * x - 3).df


@query("""SELECT * FROM (VALUES ('x', 'x'), ('3 * x', '3*x'), ('x + 1', 'x + 1'), ('(x + 1) / 2', '(x + 1)/2'), ('constant', '7'), ('range', 'x...x + 3'), ('all', '_')) t(map, text)""")
def indexmap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = axis(0)
    maps = {"x": x, "3 * x": 3 * x, "x + 1": x + 1, "(x + 1) / 2": (x + 1) / 2, "constant": span(7, 8), "range": span(x, x + 2), "all": ALL}
    return spark.createDataFrame([(n, str(m)) for n, m in maps.items()], "map string, text string")


@query("""SELECT type, op, value FROM (VALUES ('Int8', -128, 127), ('Int16', -32768, 32767), ('Int32', -2147483648, 2147483647), ('Int64', -9223372036854775808, 9223372036854775807),
('Uint8', 0, 255), ('Uint16', 0, 65535), ('Uint32', 0, 4294967295), ('Uint64', 0, 18446744073709551615)) t(type, low, high),
LATERAL (VALUES ('sum', '0'), ('product', '1'), ('min', CAST(high AS VARCHAR)), ('max', CAST(low AS VARCHAR)), ('bit_or', '0'), ('bit_and', CASE WHEN low = 0 THEN CAST(high AS VARCHAR) ELSE '-1' END)) o(op, value)
UNION ALL SELECT type, op, value FROM (VALUES ('Float32'), ('Float64')) t(type), (VALUES ('sum', '0.0'), ('product', '1.0'), ('min', 'inf'), ('max', '-inf'), ('bit_or', 'unsupported'), ('bit_and', 'unsupported')) o(op, value)
UNION ALL SELECT type, op, value FROM (VALUES ('Complex32'), ('Complex64')) t(type), (VALUES ('sum', '0j'), ('product', '(1+0j)'), ('min', 'unsupported'), ('max', 'unsupported'), ('bit_or', 'unsupported'), ('bit_and', 'unsupported')) o(op, value)
UNION ALL SELECT type, op, 'unsupported' FROM (VALUES ('KeyAndInt64'), ('KeyAndFloat64')) t(type), (VALUES ('sum'), ('product'), ('min'), ('max'), ('bit_or'), ('bit_and')) o(op)""")
def reduction_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each reduction of each scalar type, or that there is none."""
    rows = [(t.name, op, str(identity(t, op)) if supports(t, op) else "unsupported") for t in TYPES.values() for op in REDUCTIONS]
    return spark.createDataFrame(rows, "type string, op string, value string")


@query("""WITH s AS (SELECT l_linenumber AS d0, sum(CAST(l_partkey AS HUGEINT) * 7919) AS s FROM lineitem GROUP BY 1)
SELECT d0, CAST((s + 32768) % 65536 - 32768 AS SMALLINT) AS i16, CAST((s + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS i32, CAST(s % 256 AS SMALLINT) AS u8, CAST(s % 65536 AS INTEGER) AS u16, CAST(s % 4294967296 AS BIGINT) AS u32 FROM s""")
def reduce_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that wrap, of signed and unsigned types; values are wrapped into the type before they are added, as a cast would."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("d0"), (F.col("l_partkey") * 7919).alias("v"))
    types = {"i16": "Int16", "i32": "Int32", "u8": "Uint8", "u16": "Uint16", "u32": "Uint32"}
    return rows.groupBy("d0").agg(*(aggregate("sum", wrap(F.col("v"), TYPES[t]), TYPES[t]).alias(n) for n, t in types.items()))


@query("""SELECT o_orderkey, a < b OR (a = b AND o_orderkey % 3 < o_custkey % 3) AS less FROM (SELECT *, CAST(o_orderkey % 4 AS DOUBLE) AS a, CAST(o_custkey % 4 AS DOUBLE) AS b FROM orders)""")
def key_value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of value and key are ordered by value, then by key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pair = lambda x: S.key_value((x % 4).cast("double"), x % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.key_value_less(pair(k), pair(c)).alias("less"))


@query("""SELECT CAST(k AS INT) AS job, CAST(sum(i + k) AS BIGINT) AS v FROM range(0, 16) a(k), range(0, 100) b(i) GROUP BY 1""")
def concurrent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrays are computed by threads that share one session; what is read after waiting for each is their sums."""
    runner, x, found = Runner(spark, 16), axis(0), []
    for k in range(16):
        a, out = ArrayFrame(spark, [100], I64), ArrayFrame(spark, [], I64)
        elementwise(spark, [100], ExprKernel(lambda d, k: d[0] + k), write(a[x]), k)
        reduce_elements(spark, [100], ExprKernel(lambda d, v: v), reduce("sum", privatize(x), out), a[x])
        runner.compute(out)
        found.append((k, out))
    rows = []
    for k, out in found:
        runner.synchronize(out)
        rows.append(out.df.select(F.lit(k).alias("job"), "v"))
    runner.shutdown()
    first, *rest = rows
    for r in rest:
        first = first.union(r)
    return first


@query("""SELECT CAST(i AS BIGINT) AS d0, CAST(24 + i AS BIGINT) AS v FROM range(0, 6) t(i)""")
def view_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-array at two leading coordinates of a rank-3 array."""
    return ArrayFrame(spark, [3, 4, 6], I64).iota().at(1, 0).df


@query("""SELECT * FROM (VALUES ('rank', 2), ('volume', 600), ('size0', 30), ('size1', 20), ('size2', 1), ('chunks', 12), ('empty', 0), ('written', 0), ('written_after', 1), ('reset', 0)) t(name, value)""")
def array_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an array says of itself, before and after its first write and after reset."""
    a = ArrayFrame(spark, [30, 20], I64, [10, 5])
    said = {"rank": a.rank, "volume": a.volume, "size0": a.size(0), "size1": a.size(1), "size2": a.size(2), "chunks": a.distribution.num_chunks, "empty": int(a.is_empty), "written": int(a.has_instance)}
    a.fill(1)
    said["written_after"] = int(a.has_instance)
    a.reset()
    said["reset"] = int(a.has_instance)
    return spark.createDataFrame(list(said.items()), "name string, value int")
