import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions.dtypes import REDUCTIONS, TYPES, UnsupportedReduction, identity, supports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_integer_functions(spark):
    pairs = [(7, 4), (-7, 4), (7, -4), (-7, -4), (2**62, 3), (-(2**62), 7), (0, 5), (12, -4)]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", S.div_floor(a, b).alias("f"), S.div_ceil(a, b).alias("c"), S.round_up_to_multiple(a, b).alias("m")).collect():
        assert (r.f, r.c, r.m) == (r.a // r.b, -(-r.a // r.b), -(-r.a // abs(r.b)) * abs(r.b))
    rows = spark.createDataFrame([(x,) for x in (-1, 0, 1, 3, 16, 17, 65, 2**40 + 1)], "a long").select("a", S.round_up_to_power_of_two(a).alias("p"), S.is_power_of_two(a).alias("i")).collect()
    for r in rows:
        assert r.p == (1 if r.a <= 1 else 1 << (r.a - 1).bit_length()) and r.i == (r.a > 0 and r.a & (r.a - 1) == 0)


@pytest.mark.parametrize(
    ("f", "dtype", "a", "b", "expected"),
    [
        (S.checked_add, "Int32", 2**31 - 1, 1, None), (S.checked_add, "Int32", -(2**31), -1, None), (S.checked_sub, "Int32", 2**31 - 1, -1, None),
        (S.checked_mul, "Int32", -(2**31), -1, None), (S.checked_mul, "Int32", 2**31 - 1, -1, -2147483647), (S.checked_sub, "Uint32", 0, 1, None),
        (S.checked_add, "Int8", 127, 1, None), (S.checked_mul, "Int8", 127, -1, -127), (S.checked_add, "Int64", 2**63 - 1, 1, None), (S.checked_add, "Int64", 5, 6, 11),
        (S.checked_add, "Uint64", 15 * 10**18, 1, 15 * 10**18 + 1), (S.checked_add, "Uint64", 2**64 - 1, 1, None), (S.checked_sub, "Uint64", 0, 1, None),
        (S.checked_mul, "Uint64", 2**32, 2**32 - 1, 2**64 - 2**32), (S.checked_mul, "Uint64", 2**64 - 1, 2**64 - 1, None), (S.checked_mul, "Int64", -(2**63), 2**63 - 1, None),
    ],
)
def test_checked(spark, f, dtype, a, b, expected):
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)") if abs(x) >= 2**63 else F.lit(x)
    column = f(wide(a), wide(b), TYPES[dtype])
    if expected is None:
        with pytest.raises(Exception, match="overflow"):
            one(spark, column)
    else:
        assert one(spark, column) == expected


def test_checked_folds(spark):
    df = spark.createDataFrame([(1,), (2,), (2**31 - 1,), (4,)], "v long")
    assert df.agg(S.checked_sum(F.col("v"), TYPES["Int64"]).alias("x")).first().x == 2147483654
    assert df.where("v = 0").agg(S.checked_sum(F.col("v"), TYPES["Int64"], 5).alias("x")).first().x == 5
    with pytest.raises(Exception, match="overflow"):
        df.where("v = 4").agg(S.checked_sum(F.col("v"), TYPES["Int8"], 124).alias("x")).first()
    with pytest.raises(Exception, match="overflow"):
        df.agg(S.checked_sum(F.col("v"), TYPES["Int32"]).alias("x")).first()
    values = F.array(*(F.lit(x).cast("bigint") for x in (1, (2**31 - 1) // 2, 3)))
    assert one(spark, S.checked_fold_product(values, TYPES["Int64"])) == 3221225469
    with pytest.raises(Exception, match="overflow"):
        one(spark, S.checked_fold_product(F.transform(values, lambda v: v.cast("int")), TYPES["Int32"]))


def test_exact_comparison(spark):
    ints = [0, 1, -1, 127, -128, 2**31, -(2**31), 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    floats = [0.0, 0.999, -0.01, 1.0, -1.5, 2.0**53, 2.0**63, -(2.0**63), 2.0**70, math.inf, -math.inf, math.nan, 9.007199254740994e15]
    df = spark.createDataFrame([(i, f) for i in ints for f in floats], "i long, f double")
    i, f = F.col("i"), F.col("f")
    for r in df.select("i", "f", S.is_less(i, "int", f, "float").alias("lt"), S.is_less(f, "float", i, "int").alias("gt"), S.is_equal(i, "int", f, "float").alias("eq"), S.is_convertible(f, "float", TYPES["Int32"]).alias("c")).collect():
        assert (r.lt, r.gt, r.eq) == (r.i < r.f, r.i > r.f, r.i == r.f), r
        assert r.c == (math.isfinite(r.f) and r.f == int(r.f) and -(2**31) <= r.f < 2**31), r


def test_checked_cast(spark):
    assert one(spark, S.checked_cast(F.lit(201.0), "float", TYPES["Uint8"])) == 201
    for value, kind, dtype in ((2**63 - 1, "int", "Int32"), (200, "int", "Int8"), (-1337, "int", "Uint8"), (0.5, "float", "Int8")):
        with pytest.raises(Exception, match="lossy"):
            one(spark, S.checked_cast(F.lit(value), kind, TYPES[dtype]))
    assert one(spark, S.in_range(F.lit(3), "int", F.lit(4))) and not one(spark, S.in_range(F.lit(-1), "int", F.lit(4)))


def test_key_value_order(spark):
    pair = lambda v, k: S.key_value(F.lit(float(v)), F.lit(k))
    assert one(spark, S.key_value_less(pair(123, 1), pair(123, 2))) and one(spark, S.key_value_less(pair(123, 2), pair(456, 2)))
    assert one(spark, S.key_value_less(pair(123, 2), pair(math.nan, 3))) and not one(spark, S.key_value_less(pair(math.nan, 3), pair(math.nan, 3)))
    assert one(spark, S.hash_combine(F.lit(1), F.lit(2))) != one(spark, S.hash_combine(F.lit(2), F.lit(1)))


def test_identities():
    assert len(TYPES) == 14
    assert identity(TYPES["Int8"], "min") == 127 and identity(TYPES["Int8"], "bit_and") == -1 and identity(TYPES["Uint64"], "bit_and") == 2**64 - 1
    assert identity(TYPES["Float32"], "max") == -math.inf and identity(TYPES["Complex64"], "product") == 1
    for name, op in (("Float64", "bit_or"), ("Complex32", "min"), ("KeyAndInt64", "sum")):
        with pytest.raises(UnsupportedReduction):
            identity(TYPES[name], op)
    assert sum(supports(t, op) for t in TYPES.values() for op in REDUCTIONS) == 8 * 6 + 2 * 4 + 2 * 2


def test_random_wrap(spark):
    from gridloom.functions.dtypes import wrap

    rng = random.Random(1)
    values = [rng.randint(-(2**70), 2**70) for _ in range(40)]
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal(v),) for v in values], "v decimal(38,0)")
    for name in ("Int8", "Uint16", "Int32", "Int64", "Uint64"):
        t = TYPES[name]
        low = t.limits[0]
        narrow = [v if t.bits == 64 else v >> 12 for v in values]
        got = df.select(wrap(F.col("v") if t.bits == 64 else F.floor(F.col("v") / 4096).cast("decimal(38,0)"), t).alias("x")) if t.bits == 64 else None
        if got is not None:
            assert [int(r.x) for r in got.collect()] == [(v - low) % (1 << t.bits) + low for v in narrow]
