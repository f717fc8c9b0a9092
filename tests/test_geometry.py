import itertools
import random

import pytest

from gridloom.functions.geometry import Bounds, Dim, Point, Range

EMPTY, ONE, MIDDLE, MAX = Range(0, 0), Range(0, 8), Range(5, 10), Range(-(2**31), 2**31 - 1)


def test_range():
    assert EMPTY.intersection(MIDDLE) == Range(5, 0) and ONE.intersection(MIDDLE) == Range(5, 8)
    assert MIDDLE.contains(EMPTY) and not EMPTY.overlaps(EMPTY) and ONE.overlaps(MIDDLE) and MAX.contains(MIDDLE)
    assert not ONE.contains(8) and ONE.contains(0) and EMPTY.size == 0 and Range(5, 0).size == 0 and Range(5, 0).is_empty
    assert Range(5, 25).split_at(10) == (Range(5, 10), Range(10, 25))
    assert Range(5, 25).split_at(99) == (Range(5, 25), Range(25, 25)) and Range(5, 25).split_at(0) == (Range(5, 5), Range(5, 25))
    assert Range(5, 25).shift_by(10) == Range(15, 35) and str(MIDDLE) == "5...10"


A, B = Bounds.of([1, 1, 1]), Bounds.of([1, 2, 3])
C, D = Bounds.of([(4, 10), (20, 10), (0, 7)]), Bounds.of([(-1, 1), (1, 2), (2, 3)])


def test_bounds():
    assert [x.volume for x in (A, B, C, D)] == [1, 6, 0, 2]
    assert A.intersection(C) == Bounds.of([(4, 1), (20, 1), (0, 1)])
    assert A.unite(C) == Bounds.of([(0, 10), (0, 10), (0, 7)]) and C.unite(D) == Bounds.of([(-1, 10), (1, 10), (0, 7)])
    assert A.contains(C) and not A.overlaps(C)
    for x, y in itertools.product((A, B, C, D), repeat=2):
        assert x.intersection(y) == y.intersection(x) and x.unite(y) == y.unite(x) and x.overlaps(y) == y.overlaps(x)
    head, tail = Bounds.of([10, 20, 30]).split_along(1, 10)
    assert head == Bounds.of([10, 10, 30]) and tail == Bounds.of([10, (10, 20), 30])
    whole, none = Bounds.of([10, 20, 30]).split_along(10, 5)
    assert whole == Bounds.of([10, 20, 30]) and none.is_empty
    assert Bounds.of([3, 2, 1]) == Bounds.of([3, 2]) and Bounds().volume == 1 and Bounds.of([3]).concat(Bounds.of([4])) == Bounds.of([3, 4])
    assert hash(Bounds.of([3, 2, 1])) == hash(Bounds.of([3, 2]))


def test_dim_and_point():
    assert Dim([1, 2, 3]).volume == 6 and Dim([1, -1, 1]).volume == 0 and Dim([1, 0, 1]).volume == 0
    with pytest.raises(ValueError):
        Dim([1, 2, 3]).to_rank(2)
    assert tuple(Dim([-1, 1, 1]).to_rank(2)) == (-1, 1) and tuple(Dim([1, 2, 3]).to_rank(4)) == (1, 2, 3, 1)
    assert Dim([-1, 2]) == Dim([-1, 2, 1]) and Dim([2, 3]).contains([1, 2]) and not Dim([2, 3]).contains([2, 0])
    with pytest.raises(ValueError):
        Point([1, 2, 3]).to_rank(2)
    assert tuple(Point([1, 2, 3]).to_rank(4)) == (1, 2, 3, 0) and tuple(Point([-1, 1, 0]).to_rank(2)) == (-1, 1) and Point([5]) == Point([5, 0])


def test_columns_follow_the_values(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import geometry as G

    rng = random.Random(4)
    boxes = [tuple((b := rng.randint(-4, 4), b + rng.randint(-1, 5)) for _ in range(2)) for _ in range(60)]
    pairs = [(*[x for r in p for x in r], *[x for r in q for x in r]) for p, q in zip(boxes, boxes[1:])]
    df = spark.createDataFrame(pairs, "a0 long, a1 long, a2 long, a3 long, b0 long, b1 long, b2 long, b3 long")
    box = lambda s: F.array(G.range_struct(F.col(f"{s}0"), F.col(f"{s}1")), G.range_struct(F.col(f"{s}2"), F.col(f"{s}3")))
    a, b = box("a"), box("b")
    rows = df.select(*df.columns, G.bounds_volume(a).alias("volume"), G.bounds_overlaps(a, b).alias("o"), G.bounds_contains(a, b).alias("c"), G.bounds_intersection(a, b).alias("i"), G.bounds_unite(a, b).alias("u")).collect()
    for r in rows:
        x, y = Bounds.of([(r[0], r[1]), (r[2], r[3])]), Bounds.of([(r[4], r[5]), (r[6], r[7])])
        back = lambda v: Bounds.of([(e["begin"], e["end"]) for e in v])
        assert (r.volume, r.o, r.c, back(r.i), back(r.u)) == (x.volume, x.overlaps(y), x.contains(y), x.intersection(y), x.unite(y))


def test_constructors():
    from gridloom.functions.geometry import Bounds, Dim, Point, Range

    assert Dim.fill(3, 7) == Dim([7, 7, 7]) and Dim.one(2) == Dim([]) and Dim.zero(2).is_empty and Point.zero(3) == Point([])
    assert Dim.from_([2, 3], 4) == Dim([2, 3, 1, 1]) and Dim.from_([2, 3], 1) == Dim([2]) and Point.from_([4]) == Point([4, 0])
    assert Dim([2, 1]).is_convertible_to(1) and not Dim([2, 3]).is_convertible_to(1) and Point([1, 0, 0]).is_convertible_to(1)
    assert Bounds.zero(2).is_empty and Bounds.one(2).volume == 1 and Bounds.one(2) == Bounds.of([Range(0, 1)])
