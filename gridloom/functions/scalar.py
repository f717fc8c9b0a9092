"""Integer and comparison functions as columns. ANSI mode is on in Spark 4: plain +, - and * raise on overflow, as the checked forms must."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtypes import ScalarType


def div_floor(a: Column, b: Column) -> Column:
    """Quotient rounded toward minus infinity, for any signs."""
    q = _div(a, b)
    return F.when((_rem(a, b) != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def _div(a: Column, b: Column) -> Column:
    """Truncating quotient, as bigint."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def _rem(a: Column, b: Column) -> Column:
    return a.cast("bigint") % b.cast("bigint")


def div_trunc(a: Column, b: Column) -> Column:
    """Quotient rounded toward zero."""
    return _div(a, b)


def div_ceil(a: Column, b: Column) -> Column:
    """Quotient rounded toward plus infinity, for any signs."""
    q = _div(a, b)
    return F.when((_rem(a, b) != 0) & ((a < 0) == (b < 0)), q + 1).otherwise(q)


def round_up_to_multiple(a: Column, multiple: Column) -> Column:
    """The smallest multiple that isn't below a; the sign of `multiple` doesn't matter."""
    m = F.abs(multiple.cast("bigint"))
    return div_ceil(a, m) * m


def round_up_to_power_of_two(a: Column) -> Column:
    """The smallest power of two that isn't below a; 1 for a <= 1."""
    x = a.cast("bigint") - 1
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.when(a <= 1, F.lit(1).cast("bigint")).otherwise(x + 1)


def is_power_of_two(a: Column) -> Column:
    x = a.cast("bigint")
    return F.when(x > 0, x.bitwiseAND(x - 1) == 0).otherwise(F.lit(False))


def checked(value: Column, dtype: ScalarType, message: str = "overflow") -> Column:
    """An exact wide value (bigint or decimal) as dtype; raises when it doesn't fit."""
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in dtype.limits)
    wide = value.cast("decimal(38,0)")
    return F.when(value.isNull() | wide.between(low, high), wide.cast(dtype.spark)).otherwise(F.raise_error(F.lit(message)).cast(dtype.spark))


def tried(value: Column, dtype: ScalarType) -> Column:
    """As checked(), but null where the value doesn't fit."""
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in dtype.limits)
    wide = value.cast("decimal(38,0)")
    return F.when(wide.between(low, high), wide.cast(dtype.spark))


def _wide(a: Column) -> Column:
    return a.cast("decimal(20,0)")


def checked_add(a: Column, b: Column, dtype: ScalarType) -> Column:
    return checked(_wide(a) + _wide(b), dtype)


def checked_sub(a: Column, b: Column, dtype: ScalarType) -> Column:
    return checked(_wide(a) - _wide(b), dtype)


def product(a: Column, b: Column) -> Column:
    """The exact product as a decimal of 38 digits, or null where it has more (no integer type has)."""
    return F.try_multiply(_wide(a), _wide(b)).cast("decimal(38,0)")


def checked_mul(a: Column, b: Column, dtype: ScalarType, message: str = "overflow") -> Column:
    exact = product(a, b)
    return F.when(exact.isNull() & a.isNotNull() & b.isNotNull(), F.raise_error(F.lit(message)).cast(dtype.spark)).otherwise(checked(exact, dtype, message))


def checked_neg(a: Column, dtype: ScalarType) -> Column:
    return checked(-_wide(a), dtype)


def checked_sum(a: Column, dtype: ScalarType, initial: int = 0) -> Column:
    """Aggregate: the exact sum and an initial value, raising when it doesn't fit dtype; the initial value for no rows."""
    return checked(F.coalesce(F.sum(_wide(a)), F.lit(0)) + F.lit(str(initial)).cast("decimal(20,0)"), dtype)


def checked_fold_product(values: Column, dtype: ScalarType, initial: int = 1) -> Column:
    """The product of an array, raising as soon as a partial product doesn't fit dtype."""
    return F.aggregate(values, F.lit(str(initial)).cast(dtype.spark), lambda acc, x: checked_mul(acc, x, dtype))


def _exact(a: Column, kind: str) -> Column:
    """Integers as decimals; floats stay."""
    return a if kind == "float" else a.cast("decimal(20,0)")


def compare(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    """-1, 0 or 1 as numbers compare, whatever the types; null if a float is NaN (nothing is less, equal or greater than it).

    A float meets an integer through its whole part, which a decimal holds exactly, and then its fraction.
    """
    if a_kind == b_kind == "float":
        return F.when(F.isnan(a) | F.isnan(b), F.lit(None)).when(a < b, -1).when(a > b, 1).otherwise(0)
    if a_kind != "float" and b_kind != "float":
        x, y = _exact(a, a_kind), _exact(b, b_kind)
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)
    if a_kind == "float":
        return -compare(b, b_kind, a, a_kind)
    f, i = b.cast("double"), _exact(a, a_kind)
    top = F.lit(2.0**64)
    # through bigint, as doubles reach decimals by way of their shortest text; from 2**62 on they are multiples of 4
    near = F.floor(F.when(F.abs(f) < 2.0**62, f).otherwise(0.0)).cast("decimal(20,0)")
    whole = F.when(F.abs(f) < 2.0**62, near).otherwise(F.when(F.abs(f) < top, f / 4).otherwise(0.0).cast("bigint").cast("decimal(20,0)") * 4)
    fraction = F.when(F.abs(f) < 2.0**53, f - F.floor(f)).otherwise(0.0)
    return F.when(F.isnan(f), F.lit(None)).when(f >= top, -1).when(f <= -top, 1).when(i < whole, -1).when(i > whole, 1).when(fraction > 0, -1).otherwise(0)


def is_less(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    return F.coalesce(compare(a, a_kind, b, b_kind) < 0, F.lit(False))


def is_less_equal(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    return F.coalesce(compare(a, a_kind, b, b_kind) <= 0, F.lit(False))


def is_equal(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    return F.coalesce(compare(a, a_kind, b, b_kind) == 0, F.lit(False))


def is_greater(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    return is_less(b, b_kind, a, a_kind)


def is_greater_equal(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
    return is_less_equal(b, b_kind, a, a_kind)


def is_convertible(a: Column, kind: str, dtype: ScalarType) -> Column:
    """Whether the value can be held by dtype without loss; floats of any kind hold each other's NaN and infinities."""
    if dtype.kind == "float":
        if kind == "float":
            return F.isnan(a) | (a.cast(dtype.spark).cast("double") == a.cast("double"))
        return is_equal(a, kind, a.cast(dtype.spark), "float")
    low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in dtype.limits)
    inside = is_less_equal(low, "int", a, kind) & is_less_equal(a, kind, high, "int")
    return inside & (a == F.floor(a)) if kind == "float" else inside


def checked_cast(a: Column, kind: str, dtype: ScalarType) -> Column:
    """The value as dtype; raises when it can't be held without loss."""
    return F.when(is_convertible(a, kind, dtype), a.cast(dtype.spark)).otherwise(F.raise_error(F.lit("lossy conversion")).cast(dtype.spark))


def in_range(a: Column, kind: str, n: Column, n_kind: str = "int") -> Column:
    """0 <= a < n, for whole numbers."""
    whole = (a == F.floor(a)) if kind == "float" else F.lit(True)
    return is_less_equal(F.lit(0), "int", a, kind) & is_less(a, kind, n, n_kind) & whole


def hash_combine(*fields: Column) -> Column:
    """A hash that depends on the order of its fields."""
    return F.xxhash64(*fields)


def key_value(value: Column, key: Column) -> Column:
    """A pair ordered by value, then key: min and max of it are arg-min and arg-max."""
    return F.struct(value.alias("value"), key.alias("key"))


def key_value_less(a: Column, b: Column) -> Column:
    """The order of two pairs; values that don't compare (NaN) count as a tie, which the key decides."""
    return F.when(_ordered(a, b) & (a["value"] < b["value"]), True).when(_ordered(a, b) & (a["value"] > b["value"]), False).otherwise(a["key"] < b["key"])


def _ordered(a: Column, b: Column) -> Column:
    return ~(F.isnan(a["value"].cast("double")) | F.isnan(b["value"].cast("double")))
