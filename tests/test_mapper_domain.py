import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import Bounds, Range
from gridloom.plans.domain import Distribution, tile_domain
from gridloom.plans.mapper import ALL, IndexMap, axis, index_map, region, span, tile


def covered(m, begin, size):
    """The union of (scale * a + offset + [0, length)) / divisor over the axis values of a chunk, for values from 0 on."""
    cells = [m.scale * a + m.offset + k for a in range(begin, begin + size) for k in range(m.length)]
    return min(c // m.divisor for c in cells), max(c // m.divisor for c in cells) + 1


def test_interval_covers_what_its_cells_touch():
    rng = random.Random(2)
    for _ in range(2000):
        m = IndexMap(0, rng.choice([-3, -2, -1, 1, 2, 5]), rng.randint(60, 90), rng.randint(1, 6), rng.choice([1, 1, 2, 3, 4]))
        begin, size = rng.randint(0, 9), rng.randint(1, 6)
        r = m.interval(begin, size)
        assert (r.begin, r.end) == covered(m, begin, size), m


def test_columns_follow_interval(spark):
    rng = random.Random(3)
    maps = [IndexMap(0, rng.randint(-3, 3), rng.randint(-20, 20), rng.randint(0, 5), rng.choice([1, 2, 3])) for _ in range(25)]
    df = spark.createDataFrame([(b, n) for b in range(-6, 7, 3) for n in range(0, 4)], "b long, n long")
    columns = [c.alias(f"x{k}_{j}") for k, m in enumerate(maps) for j, c in enumerate(m.apply(F.col("b"), F.col("n")))]
    for r in df.select("b", "n", *columns).collect():
        for k, m in enumerate(maps):
            assert Range(r[f"x{k}_0"], r[f"x{k}_1"]) == m.interval(r.b, r.n), (m, r.b, r.n)


def test_map_algebra():
    x = axis(0)
    assert (x + 1).interval(3, 4) == Range(4, 8) and (2 - x).interval(0, 3) == Range(0, 3) and (x * 3).interval(1, 2) == Range(3, 7)
    assert (3 * x // 2).interval(2, 1) == Range(3, 4) and (+x) == x and (-(-x)) == x
    assert span(x - 1, x + 1).interval(5, 2) == Range(4, 8) and span(3, 7).interval(0, 9) == Range(3, 7) and span(4).interval(1, 1) == Range(0, 4)
    with pytest.raises(ValueError):
        span(x, axis(1))
    with pytest.raises(ZeroDivisionError):
        x // 0
    assert (x // -2).divisor == 2 and (x // -2).scale == -1
    assert index_map(5).interval(9, 9) == Range(5, 6)
    assert region((ALL, axis(1)), (0, 4), (2, 3), (10, 6)) == Bounds.of([10, (4, 6)])
    assert region(tile(2, 3), (1, 1), (2, 1)) == Bounds.of([(2, 6), (3, 6)])
    assert str(x) == "x" and str(3 * axis(1)) == "3*y...3*y + 1" or str(3 * axis(1)) == "3*y"


def test_tile_domain(spark):
    rows = [tuple(r) for r in tile_domain(spark, [25, 7], [10, 4], owners=2).orderBy("chunk_id").collect()]
    assert rows == [(k, k % 2, k % 3 * 10, k // 3 * 4, 0, min(10, 25 - k % 3 * 10), min(4, 7 - k // 3 * 4), 1) for k in range(6)]
    assert tile_domain(spark, [0, 5], [1, 1]).count() == 0
    with pytest.raises(ValueError):
        tile_domain(spark, [5], [0])
    with pytest.raises(ValueError):
        tile_domain(spark, [5], [1], owners=0)


CHUNKS_2D = [(1, (0, 0), (15, 10)), (2, (0, 10), (15, 10)), (3, (0, 20), (15, 7)), (4, (15, 0), (14, 10)), (5, (15, 10), (14, 10)), (6, (15, 20), (14, 7))]


def test_distribution_from_chunks():
    rng = random.Random(5)
    for _ in range(5):
        chunks = CHUNKS_2D[:]
        rng.shuffle(chunks)
        d = Distribution.from_chunks([29, 27], chunks)
        assert tuple(d.chunk) == (15, 10) and d.owners == (1, 2, 3, 4, 5, 6)
        for k, (_, o, s) in enumerate(CHUNKS_2D):
            assert d.chunk_bounds(k) == Bounds.from_offset_size(o, s) and d.chunk_of_region(d.chunk_bounds(k)) == k
    one = Distribution.from_chunks([26], [(2, (20,), (6,)), (0, (0,), (10,)), (1, (10,), (10,))])
    assert one.owners == (0, 1, 2) and one.num_chunks == 3


@pytest.mark.parametrize(
    ("chunks", "message"),
    [
        ([*CHUNKS_2D[:5], (6, (14, 20), (14, 7))], "aligned"), ([*CHUNKS_2D, CHUNKS_2D[0]], "two chunks"), (CHUNKS_2D[:5], "missing"),
        ([(1, (0, 0), (0, 10))], "empty"), ([], "no chunks"), ([*CHUNKS_2D[:5], (6, (15, 20), (14, 6))], "wrong size"),
    ],
)
def test_distribution_errors(chunks, message):
    with pytest.raises(ValueError, match=message):
        Distribution.from_chunks([29, 27], chunks)


def test_regions():
    d = Distribution([29, 27], [15, 10])
    with pytest.raises(IndexError, match="more than one"):
        d.chunk_of_region(Bounds.of([(14, 16), (0, 1)]))
    with pytest.raises(IndexError, match="inside"):
        d.chunk_of_region(Bounds.of([(0, 1), (26, 28)]))
    with pytest.raises(IndexError):
        d.chunk_bounds(6)
    with pytest.raises(ValueError):
        Distribution([4], [2], [1])
    both = Distribution.from_chunks([4], [(0, (0,), (4,)), (1, (0,), (4,))], allow_duplicates=True)
    assert both.owners == (-1,)
