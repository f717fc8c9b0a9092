import math
import threading
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.dtypes import TYPES
from gridloom.functions.geometry import Bounds
from gridloom.operators.access import privatize, read, reduce, write
from gridloom.operators.arrayframe import ArrayFrame, index_space, scalar
from gridloom.operators.reduce import arg_max, arg_min, reduce_cells
from gridloom.operators.submit import ChunkKernel, ExprKernel, elementwise, parallel_submit, reduce_elements, submit
from gridloom.plans.domain import Distribution, tile_domain
from gridloom.plans.mapper import ALL, ONE_TO_ONE, axis, span
from gridloom.sources.host import allocate
from gridloom.streaming.events import Event, Runner, join

X, Y, Z = axis(0), axis(1), axis(2)


@pytest.mark.parametrize("rank", range(7))
def test_round_trip_of_every_rank(spark, rank):
    data = np.arange(2**rank, dtype=np.int64).reshape([2] * rank)
    a = allocate(spark, data)
    assert a.rank == rank and a.volume == data.size and (a.copy_to() == data).all()
    assert a.copy_to_vector() == data.reshape(-1).tolist()


@pytest.mark.parametrize("name", ["Int8", "Int16", "Int32", "Int64", "Uint8", "Uint16", "Uint32", "Uint64", "Float32", "Float64", "Complex32", "Complex64"])
def test_round_trip_of_every_type(spark, name):
    t = TYPES[name]
    values = [0, 1, *t.limits] if t.integral else [0.5, 1, -2, 1 + 2j] if t.kind == "complex" else [0.5, 1.0, -2.0, 3.0]
    data = np.array(values, dtype=t.numpy)
    a = allocate(spark, data, name)
    assert (a.copy_to() == data).all() and a.copy_to().dtype == data.dtype
    assert (ArrayFrame(spark, [4], name).copy_bytes_from(a.copy_bytes_to()).copy_to() == data).all()


def test_host_errors(spark):
    a = ArrayFrame(spark, [3], "Int64")
    with pytest.raises(RuntimeError):
        _ = a.df
    with pytest.raises(ValueError):
        a.copy_from([1, 2])
    with pytest.raises(ValueError):
        a.copy_bytes_from(b"123")
    with pytest.raises(ValueError):
        ArrayFrame(spark, [1] * 7)
    a.copy_from([1, 2, 3])
    assert a.has_instance and a.size(0) == 3 and a.size(5) == 1
    a.reset()
    assert not a.has_instance
    assert scalar(spark, 5, "Int64").value() == 5


def test_views(spark):
    data = np.arange(24).reshape(2, 3, 4)
    a = allocate(spark, data)
    assert a.strides() == (12, 4, 1) and a.strides("column") == (1, 2, 6)
    assert (a.at(1).copy_to() == data[1]).all() and a.at(1, 2, 3).value() == 23 and (a.drop_axis(1, 2).copy_to() == data[:, 2]).all()
    cut = a.slice(Bounds.of([(0, 2), (1, 3), (2, 4)]))
    assert (cut.copy_to() == data[:, 1:3, 2:4]).all() and cut.offset == (0, 1, 2)
    assert (cut.drop_axis(1).copy_to() == data[:, 1, 2:4]).all()
    moved = cut.shift_to_origin()
    assert moved.offset == (0, 0, 0) and (moved.copy_to() == cut.copy_to()).all() and cut.shift_axis_to(2, 9).offset == (0, 1, 9) and cut.shift_by(1).offset == (1, 1, 2)
    with pytest.raises(IndexError):
        a.at(2)
    with pytest.raises(IndexError):
        a.slice(Bounds.of([3, 3, 4]))
    rows = allocate(spark, np.zeros((4, 2))).shift_to(100, 42).df.select("d0", "d1").count()
    assert rows == 8


def test_predicates_reach_the_scan(spark, tmp_path):
    from gridloom.sources.host import from_table

    path = str(tmp_path / "cells")
    spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("x"), F.lit("unused").alias("other")).write.parquet(path)
    a = from_table(spark.read.parquet(path), ["k"], "x", [1000], "Int64").slice(Bounds.of([(10, 20)]))
    plan = a.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,10)" in plan and "LessThan(k,20)" in plan and "other" not in plan
    assert a.df.count() == 10


def test_vector_add_and_aliases(spark):
    n = 100
    a, b, c = ArrayFrame(spark, [n], "Float32").iota(), ArrayFrame(spark, [n], "Float32").fill(1), ArrayFrame(spark, [n], "Float32")
    elementwise(spark, [n], ExprKernel(lambda d, x, y: x + y), write(c[X]), a[X], b[X])
    assert c.copy_to_vector() == [i + 1 for i in range(n)]
    with pytest.raises(RuntimeError):
        elementwise(spark, [n], ExprKernel(lambda d, x: x), write(a[X]), a[X])
    # a part of the domain: the rest stays
    elementwise(spark, [10], ExprKernel(lambda d: F.lit(-1.0)), write(c[X]))
    assert c.copy_to_vector() == [-1] * 10 + [i + 1 for i in range(10, n)]


@pytest.mark.parametrize("tiling", [(25, 20), (7, 9), (50, 40), (13, 40)])
def test_reductions_do_not_depend_on_tiles(spark, tiling):
    w, h = 50, 40
    m = ArrayFrame(spark, [w, h], "Int64", tiling)
    elementwise(spark, [w, h], ExprKernel(lambda d: d[0] + 2 * d[1]), write(m[X][Y]))
    v = np.arange(w)[:, None] + 2 * np.arange(h)
    total, rows, columns = ArrayFrame(spark, [], "Int64"), ArrayFrame(spark, [w], "Int64"), ArrayFrame(spark, [h], "Int64")
    keep = ExprKernel(lambda d, x: x)
    reduce_elements(spark, [w, h], keep, reduce("sum", privatize(X, Y), total), m[X][Y])
    reduce_elements(spark, [w, h], keep, reduce("sum", privatize(Y), rows[X]), m[X][Y])
    assert total.value() == v.sum() and rows.copy_to_vector() == v.sum(1).tolist()
    domain = ([w, h], tiling)
    parallel_submit(spark, domain, ChunkKernel(lambda c, x: x.sum(0)), reduce("sum", columns[Y]), m[X][Y])
    assert columns.copy_to_vector() == v.sum(0).tolist()


def test_every_reduction_of_every_type(spark):
    folds = {"sum": np.add, "product": np.multiply, "min": np.minimum, "max": np.maximum, "bit_and": np.bitwise_and, "bit_or": np.bitwise_or}
    rng = np.random.default_rng(6)
    for name, t in TYPES.items():
        if t.kind == "pair":
            continue
        if t.integral:
            low, high = t.limits
            data = np.array([int(x) for x in rng.integers(low, high, 40, dtype=t.numpy, endpoint=True)], dtype=t.numpy)
        elif t.kind == "float":
            data = rng.uniform(0.5, 1.5, 40).astype(t.numpy)
        else:
            data = (rng.uniform(0.5, 1.5, 40) + 1j * rng.uniform(-0.5, 0.5, 40)).astype(t.numpy)
        cells = allocate(spark, data, name).df.select((F.col("d0") % 3).alias("d0"), "v").repartition(3)
        for op, fold in folds.items():
            from gridloom.functions.dtypes import supports

            if not supports(t, op):
                continue
            got = ArrayFrame(spark, [4], name).set(reduce_cells(cells, op, name, ["d0"], index_space(spark, Bounds.of([4])))).copy_to()
            from gridloom.functions.dtypes import identity

            want = [fold.reduce(data[k::3], dtype=data.dtype) for k in range(3)] + [identity(t, op)]
            with np.errstate(over="ignore"):
                np.testing.assert_allclose(got, np.array(want, dtype=t.numpy), rtol=1e-4 if not t.integral else 0, err_msg=f"{name} {op}")


def test_products_over_many_batches(spark):
    n = 60_000  # several Arrow batches before and after the shuffle, and keys that go on from one to the next
    df = spark.range(n).select((F.col("id") % 21_001).alias("d0"), (F.col("id") % 7 + 1).alias("v")).repartition(3)
    want = np.ones(21_001, np.int64)
    np.multiply.at(want, np.arange(n) % 21_001, np.arange(n) % 7 + 1)
    got = {r.d0: r.v for r in reduce_cells(df, "product", "Int64", ["d0"]).collect()}
    assert got == dict(enumerate(want.tolist()))
    assert reduce_cells(df.select(F.lit(3).cast("bigint").alias("v")), "product", "Int64", []).first().v == (pow(3, n, 1 << 64) + (1 << 63)) % (1 << 64) - (1 << 63)


def test_nan_and_empty(spark):
    df = spark.createDataFrame([(0, math.nan), (0, 2.0), (0, 3.0), (1, math.nan)], "d0 long, v double")
    got = {r.d0: r.v for r in reduce_cells(df, "max", "Float64", ["d0"]).collect()}
    assert got == {0: 3.0, 1: -math.inf}
    assert reduce_cells(df.where("d0 > 5").select("v"), "min", "Float64", []).first().v == math.inf
    pairs = spark.createDataFrame([(0, 5, 1), (0, 5, 0), (0, 9, 7)], "g long, value long, key long")
    assert tuple(arg_min(pairs, ["g"], "value", "key").first()) == (0, 5, 0) and tuple(arg_max(pairs, ["g"], "value", "key").first()) == (0, 9, 7)


def test_reduction_ignores_old_contents(spark):
    t = ArrayFrame(spark, [3], "Int64").fill(100)
    src = ArrayFrame(spark, [3, 2], "Int64").iota()
    reduce_elements(spark, [3, 2], ExprKernel(lambda d, x: x), reduce("sum", t[X]), src[X][Y])
    assert t.copy_to_vector() == [1, 5, 9]


def test_blocked_matmul_and_struct_arguments(spark):
    @dataclass
    class Pair:
        left: object
        right: object
        scale: int

    a, b = np.arange(24).reshape(4, 6), np.arange(30).reshape(6, 5)
    fa, fb = ArrayFrame(spark, [4, 6], "Int64", [2, 3]), ArrayFrame(spark, [6, 5], "Int64", [3, 5])
    fa.copy_from(a)
    fb.copy_from(b)
    c = ArrayFrame(spark, [4, 5], "Int64")
    parallel_submit(spark, ([4, 6, 5], [2, 3, 5]), ChunkKernel(lambda chunk, x, y, s: s * (x @ y)), reduce("sum", c[X][Z]), Pair(fa[X][Y], fb[Y][Z], 2))
    assert (c.copy_to() == 2 * (a @ b)).all()


def test_strict_reads_and_halos(spark):
    a = ArrayFrame(spark, [20], "Int64", [5]).iota()
    out = ArrayFrame(spark, [20], "Int64")
    wide = ChunkKernel(lambda chunk, r, v: np.full(chunk[0].size, v.sum()) + 0 * r.size)
    with pytest.raises(Exception, match="more than one chunk"):
        parallel_submit(spark, ([20], [5]), wide, write(out[X]), X, a[span(X - 1, X + 1)]).copy_to()
    out.reset()  # the failed write is what the array would be read from
    parallel_submit(spark, ([20], [5]), wide, write(out[X]), X, a[span(X - 1, X + 1)], strict=False)
    assert out.copy_to_vector() == [x for k in range(4) for x in [sum(range(max(0, 5 * k - 1), min(20, 5 * k + 6)))] * 5]
    assert out.chunk_shape == (5,)
    whole = ArrayFrame(spark, [4], "Int64")
    parallel_submit(spark, ([4], [2]), ChunkKernel(lambda c, v: v.sum() + np.arange(c[0].begin, c[0].end)), write(whole[X]), read(allocate(spark, np.arange(6)))[ALL])
    assert whole.copy_to_vector() == [15, 16, 17, 18]
    one = ArrayFrame(spark, [2], "Int64")
    submit(spark, ChunkKernel(lambda c, k: np.array([k, k + 1])), write(one), 7)
    assert one.copy_to_vector() == [7, 8]


def test_cells_reach_chunks_packed(spark):
    from gridloom.operators.submit import packed_cells

    n = 30_000
    a, total = ArrayFrame(spark, [n, 2], "Int64").iota(), ArrayFrame(spark, [3], "Int64")
    parallel_submit(spark, ([3], [1]), ChunkKernel(lambda c, v: v[c[0].begin :: 3].sum()), reduce("sum", total[X]), a[ALL])
    plan = total.df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # many cells to a row, before they are shuffled
    assert total.copy_to_vector() == [int(np.arange(2 * n).reshape(n, 2)[k::3].sum()) for k in range(3)]
    # places out of order and with gaps, of several chunks in one batch
    cells = spark.createDataFrame([(k % 2, 7 * k % 11, k % 5, float(k)) for k in range(40)], "chunk_id long, d0 long, d1 long, v float").coalesce(1)
    rows = packed_cells(cells, ArrayFrame(spark, [11, 5], "Float32")).collect()
    assert sorted(r.chunk_id for r in rows) == [0, 1]
    found = {(r.chunk_id, int(x), float(v)) for r in rows for x, v in zip(np.frombuffer(r.at, np.int64), np.frombuffer(r.v, np.float32), strict=True)}
    assert found == {(k % 2, 7 * k % 11 * 5 + k % 5, float(k)) for k in range(40)}
    assert [len(r.at) for r in packed_cells(a.df.limit(500).select(F.lit(0).cast("bigint").alias("chunk_id"), "d0", "d1", "v").coalesce(1), a).collect()] == [8]


def test_pairs_of_chunks_meet_without_a_shuffle_of_pairs(spark):
    from gridloom.sources.host import from_table

    rng = np.random.default_rng(7)
    x, y = rng.integers(-9, 9, (23, 4)), rng.integers(-9, 9, (17, 4)).astype(np.float32)
    x[5:10] = 0
    cells = spark.createDataFrame([(i, k, int(x[i, k])) for i in range(23) for k in range(4) if not 5 <= i < 10], "d0 long, d1 long, v long")
    a = from_table(cells, ["d0", "d1"], "v", [23, 4], "Int64", [5, 4])  # its second chunk has no cells
    b = ArrayFrame(spark, [17, 4], "Float32", [6, 4]).copy_from(y)
    times = ChunkKernel(lambda chunk, p, q: p @ q.T)
    out = ArrayFrame(spark, [23, 17], "Float32")
    parallel_submit(spark, ([23, 4, 17], [5, 4, 6]), times, write(out[X][Z]), a[X][Y], b[Z][Y])
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInArrow" not in plan.split("CartesianProduct")[0]
    assert (out.copy_to() == x @ y.T).all() and out.chunk_shape == (5, 6)
    same = ArrayFrame(spark, [17, 17], "Float32")  # one array read twice, by chunks that are finer than its own
    parallel_submit(spark, ([17, 4, 17], [3, 4, 2]), times, write(same[X][Z]), b[X][Y], b[Z][Y])
    assert (same.copy_to() == y @ y.T).all()
    line = ArrayFrame(spark, [17], "Float32")  # a chunk meets one other only: gathered, as pairs would be quadratic
    parallel_submit(spark, ([17], [6]), ChunkKernel(lambda chunk, p, q: (p * q).sum(1)), write(line[X]), b[X][ALL], b[X][ALL])
    assert "CartesianProduct" not in line.df._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(line.copy_to(), (y * y).sum(1))


def test_symmetric_kernels_are_called_once_for_two_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 9, (17, 4))
    a, b = (ArrayFrame(spark, [17, 4], "Int64", [5, 4]).copy_from(x) for _ in range(2))
    times = ChunkKernel(lambda chunk, p, q: p @ q.T, symmetric=True)

    def product(size, other, second, to=(X, Z)):
        out, calls = ArrayFrame(spark, [17, 17], "Int64"), spark.sparkContext.accumulator(0)

        def counted(chunk, p, q):
            calls.add(1)
            return p @ q.T if to == (X, Z) else q @ p.T

        parallel_submit(spark, ([17, 4, 17], [size, 4, other]), ChunkKernel(counted, symmetric=True), write(out[to[0]][to[1]]), a[X][Y], second[Z][Y])
        cells = out.df.collect()
        assert len(cells) == 289 and all(r.v == x[r.d0] @ x[r.d1] for r in cells)
        return calls.value

    assert product(5, 5, a) == 10  # 4 blocks: 6 pairs and 4 with themselves
    assert product(5, 5, a, (Z, X)) == 10
    assert product(1, 1, a) == 289 - (289 - 3 * 25 - 4) // 2  # chunks that are finer than blocks
    assert product(5, 1, a) == 68  # no chunk has a mirror image
    assert product(5, 5, b) == 16  # not the same array
    part = ArrayFrame(spark, [17, 17], "Int64").fill(7)  # a later write, of a part
    parallel_submit(spark, ([15, 4, 15], [5, 4, 5]), times, write(part[X][Z]), a[X][Y], a[Z][Y])
    want = np.full((17, 17), 7)
    want[:15, :15] = (x @ x.T)[:15, :15]
    assert (part.copy_to() == want).all()


def test_kernel_errors_reach_the_caller(spark):
    def broken(chunk):
        raise ValueError("broken kernel")

    out = ArrayFrame(spark, [4], "Int64")
    with pytest.raises(Exception, match="broken kernel"):
        parallel_submit(spark, ([4], [2]), ChunkKernel(broken), write(out[X])).copy_to()


def test_element_wise_reads_must_not_lose_points(spark):
    small, out = ArrayFrame(spark, [5], "Int64").iota(), ArrayFrame(spark, [10], "Int64")
    keep = ExprKernel(lambda d, v: v)
    with pytest.raises(IndexError):
        elementwise(spark, [10], keep, write(out[X]), small[X])
    with pytest.raises(IndexError):
        elementwise(spark, [10], keep, write(out[X]), ArrayFrame(spark, [10], "Int64").iota()[X + 1])
    with pytest.raises(ValueError):
        elementwise(spark, [5], keep, write(ArrayFrame(spark, [5], "Int64")[X]), small[ALL])
    large = ArrayFrame(spark, [7, 9], "Int64").iota()
    got = ArrayFrame(spark, [4, 3], "Int64")
    elementwise(spark, [3, 4], keep, write(got[Y][X]), large[2 * X + 1][8 - Y])
    assert got.copy_to().tolist() == [[(2 * x + 1) * 9 + 8 - y for x in range(3)] for y in range(4)]
    third = ArrayFrame(spark, [9], "Int64")
    elementwise(spark, [9], ExprKernel(lambda d, v, w: v * 10 + w), write(third[X]), ArrayFrame(spark, [3], "Int64").iota()[X / 3], scalar(spark, 4, "Int64"))
    assert third.copy_to_vector() == [x // 3 * 10 + 4 for x in range(9)]
    with pytest.raises(ValueError):
        elementwise(spark, [9], ExprKernel(lambda d: d[0]), write(third[X / 3]))
    bins = ArrayFrame(spark, [4], "Int64")
    reduce_elements(spark, [9], ExprKernel(lambda d: d[0]), reduce("sum", bins[X / 3]))
    assert bins.copy_to_vector() == [3, 12, 21, 0]


def test_first_writes_cover_and_no_cell_is_written_twice(spark):
    ones = ChunkKernel(lambda c: np.ones([r.size for r in c[:1]], np.int64))
    with pytest.raises(ValueError, match="missing"):
        parallel_submit(spark, ([8], [4]), ones, write(ArrayFrame(spark, [10], "Int64")[X]))
    with pytest.raises(ValueError, match="one place"):
        parallel_submit(spark, ([8], [4]), ChunkKernel(lambda c: 1), write(ArrayFrame(spark, [4], "Int64")[ALL]))
    with pytest.raises(ValueError, match="aligned|size"):
        parallel_submit(spark, ([10], [4]), ChunkKernel(lambda c: 1), write(ArrayFrame(spark, [11], "Int64")[span(X, X + 1)]))
    with pytest.raises(ValueError, match="origin"):
        parallel_submit(spark, ([4], [4]), ChunkKernel(lambda c: 1), write(ArrayFrame(spark, [8], "Int64")[X + 4]))
    odd = tile_domain(spark, [10], [4]).where("chunk_id != 1")
    with pytest.raises(ValueError, match="missing"):
        parallel_submit(spark, odd, ones, write(ArrayFrame(spark, [10], "Int64")[X]))
    full = ArrayFrame(spark, [10], "Int64").fill(5)
    parallel_submit(spark, odd, ones, write(full[X]))
    assert full.copy_to_vector() == [1] * 4 + [5] * 4 + [1] * 2
    parallel_submit(spark, ([10], [4]), ChunkKernel(lambda c: c[0].begin), write(full[0]))
    with pytest.raises(Exception, match="two chunks write one cell"):
        full.copy_to()
    made = ArrayFrame(spark, [10, 6], "Int64")
    parallel_submit(spark, ([10, 6], [4, 6]), ChunkKernel(lambda c: c[0].begin), write(made[X][Y]))
    assert made.distribution == Distribution([10, 6], [4, 6]) and made.copy_to()[:, 0].tolist() == [0] * 4 + [4] * 4 + [8] * 2


def test_several_targets_and_private_axes(spark):
    m = allocate(spark, np.arange(24).reshape(6, 4))
    m.chunk_shape = (3, 2)
    low, high, copy = ArrayFrame(spark, [6], "Int64"), ArrayFrame(spark, [4], "Int64"), ArrayFrame(spark, [6, 4], "Int64")
    kernel = ChunkKernel(lambda c, v: (v.T, v.max(0), v * 2))  # the first target takes its private axis first
    got = parallel_submit(spark, ([6, 4], [3, 2]), kernel, reduce("min", privatize(Y), low[X]), reduce("max", high[Y]), write(copy[X][Y]), m[X][Y])
    v = m.copy_to()
    assert got == (low, high, copy) and low.copy_to_vector() == v.min(1).tolist() and high.copy_to_vector() == v.max(0).tolist() and (copy.copy_to() == 2 * v).all()

    @dataclass
    class Task:
        source: object
        out: object

    a, b = ArrayFrame(spark, [6, 4], "Int64"), ArrayFrame(spark, [6], "Int64")
    elementwise(spark, [6, 4], ExprKernel(lambda d, x: (x + 1, x)), write(a[X][Y]), Task(m[X][Y], reduce("sum", privatize(Y), b[X])))
    assert (a.copy_to() == v + 1).all() and b.copy_to_vector() == v.sum(1).tolist()
    with pytest.raises(ValueError, match="values for"):
        elementwise(spark, [6, 4], ExprKernel(lambda d, x: x), write(a[X][Y]), Task(m[X][Y], reduce("sum", b[X])))


@pytest.mark.parametrize("name", ["Int8", "Uint8", "Uint32", "Uint64", "Float32", "Complex32", "Complex64"])
def test_chunk_kernels_take_every_number(spark, name):
    t = TYPES[name]
    data = np.array([0, 1, 2, t.limits[1]] if t.integral else [0.5, 1, -2, 3], dtype=t.numpy) + (np.array(1j, t.numpy) if t.kind == "complex" else np.array(0, t.numpy))
    a, out = ArrayFrame(spark, [4], name, [2]).copy_from(data), ArrayFrame(spark, [4], name)
    parallel_submit(spark, ([4], [2]), ChunkKernel(lambda c, v: v[::-1]), write(out[X]), a[X])
    assert (out.copy_to() == data[[1, 0, 3, 2]]).all()
    total = ArrayFrame(spark, [], name)
    parallel_submit(spark, ([4], [2]), ChunkKernel(lambda c, v: v.sum(dtype=v.dtype)), reduce("sum", total), a[X])
    with np.errstate(over="ignore"):
        want = data.sum(dtype=data.dtype)
    assert total.copy_to() == want


def test_one_to_one_is_not_clipped(spark):
    a = ArrayFrame(spark, [8], "Int64", [4]).iota()
    out = ArrayFrame(spark, [8], "Int64")
    parallel_submit(spark, ([8], [4]), ChunkKernel(lambda c, v: v), write(out[X]), a[ONE_TO_ONE])
    assert out.copy_to_vector() == list(range(8))
    wide = ArrayFrame(spark, [12], "Int64")
    with pytest.raises(Exception, match="inside of the array"):
        parallel_submit(spark, ([12], [4]), ChunkKernel(lambda c, v: v), write(wide[X]), a[ONE_TO_ONE]).copy_to()


def test_aliases_through_views(spark):
    a = ArrayFrame(spark, [4, 4], "Int64").iota()
    with pytest.raises(RuntimeError):
        elementwise(spark, [4, 4], ExprKernel(lambda d, v: v), write(a[X][Y]), a.shift_by(0)[X][Y])


def test_poison_and_arrays_events(spark):
    runner = Runner(spark, 2)
    spark.sparkContext.setLocalProperty("gridloom.test", "mine")
    assert runner.submit(lambda: spark.sparkContext.getLocalProperty("gridloom.test")).result(60) == "mine"
    a, b = ArrayFrame(spark, [8], "Int64").iota(), ArrayFrame(spark, [8], "Int64").iota()

    def broken():
        raise ValueError("broken writer")

    runner.submit(broken, writes=[a])
    with pytest.raises(ValueError, match="broken writer"):
        runner.submit(lambda: 1, reads=[a.drop_axis(0, 3)]).wait(60)
    with pytest.raises(ValueError, match="broken writer"):
        runner.synchronize(a)
    runner.synchronize(b)
    runner.submit(lambda: 2, writes=[a]).wait(60)
    assert runner.submit(lambda: 3, reads=[a]).result(60) == 3
    mine = spark.range(5).persist()
    mine.count()
    runner.compute(b).wait(60)
    runner.trim_memory()
    assert mine.storageLevel.useMemory and not b.df.storageLevel.useMemory
    mine.unpersist()
    debug = Runner(spark, debug=True)
    assert debug.submit(lambda: threading.current_thread() is threading.main_thread()).result(1)
    assert debug.submit(broken).is_done


def test_events(spark):
    runner = Runner(spark, 4)
    gate, seen = threading.Event(), []
    first = runner.submit(lambda: gate.wait(20))
    second = runner.submit(lambda: spark.range(10).count(), after=[first])
    assert not first.is_done and not second.wait(0.05)
    join(first, second).on_done(lambda: seen.append(1))
    gate.set()
    assert second.result(60) == 10
    runner.synchronize()
    assert seen == [1] and Event().is_done and Event().wait(0) and runner.barrier().is_done

    def fail():
        raise ValueError("poison")

    bad = runner.submit(fail)
    with pytest.raises(ValueError, match="poison"):
        runner.submit(lambda: 1, after=[bad]).wait(60)
    arrays = [ArrayFrame(spark, [50], "Int64").iota() for _ in range(4)]
    events = [runner.compute(a) for a in arrays]
    assert join(*events).wait(120) and runner.info()["parallelism"] >= 1
    for bad in ((), (99999,)):
        with pytest.raises(ValueError):
            runner.constrain_to(*bad)
    some = runner.constrain_to(2, 0, pool="small")
    assert {(r.chunk_id, r.owner) for r in some.tile_domain([50], [10]).collect()} == {(0, 2), (1, 0), (2, 2), (3, 0), (4, 2)}
    assert some.submit(lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")).result(60) == "small"
    assert [r.owner for r in runner.tile_domain([2], [1]).collect()] == [0, 1]
    runner.trim_memory()
    runner.shutdown()
