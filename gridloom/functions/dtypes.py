"""Scalar types of array cells, how Spark stores them, and the identities of the six reductions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCTIONS = ("sum", "product", "min", "max", "bit_and", "bit_or")


class UnsupportedReduction(TypeError):
    """The reduction isn't defined for the type."""


@dataclass(frozen=True)
class ScalarType:
    """kind: int, uint, float, complex or pair (value, key). Spark has no unsigned types: the next wider one holds them."""

    name: str
    spark: str
    bits: int
    kind: str
    numpy: str

    @property
    def integral(self) -> bool:
        return self.kind in ("int", "uint")

    @property
    def limits(self) -> tuple[int, int]:
        if not self.integral:
            raise UnsupportedReduction(f"{self.name} has no integer limits")
        return (-(1 << self.bits - 1), (1 << self.bits - 1) - 1) if self.kind == "int" else (0, (1 << self.bits) - 1)

    def __str__(self) -> str:
        return self.name


def _types() -> dict[str, ScalarType]:
    wider = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}
    same = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
    out = [ScalarType(f"Int{b}", same[b], b, "int", f"int{b}") for b in same]
    out += [ScalarType(f"Uint{b}", wider[b], b, "uint", f"uint{b}") for b in wider]
    out += [ScalarType("Float32", "float", 32, "float", "float32"), ScalarType("Float64", "double", 64, "float", "float64")]
    out += [ScalarType("Complex32", "struct<re:float,im:float>", 64, "complex", "complex64"), ScalarType("Complex64", "struct<re:double,im:double>", 128, "complex", "complex128")]
    out += [ScalarType("KeyAndInt64", "struct<value:bigint,key:bigint>", 128, "pair", "void"), ScalarType("KeyAndFloat64", "struct<value:double,key:bigint>", 128, "pair", "void")]
    return {t.name: t for t in out}


TYPES = _types()


def scalar_type(name: str | np.dtype | ScalarType) -> ScalarType:
    """A type by its name or by a numpy dtype."""
    if isinstance(name, ScalarType):
        return name
    if isinstance(name, str) and name in TYPES:
        return TYPES[name]
    want = np.dtype(name).name
    for t in TYPES.values():
        if t.numpy == want:
            return t
    raise TypeError(f"no scalar type for {name}")


def supports(dtype: ScalarType, op: str) -> bool:
    """Integers have all six reductions, floats all but the bitwise ones, complex numbers sum and product, pairs none of them."""
    if op not in REDUCTIONS:
        raise ValueError(f"unknown reduction {op}")
    return {"int": True, "uint": True, "float": op not in ("bit_and", "bit_or"), "complex": op in ("sum", "product"), "pair": False}[dtype.kind]


def identity(dtype: ScalarType, op: str) -> object:
    """The value that a reduction starts from and that cells without a contribution hold."""
    if not supports(dtype, op):
        raise UnsupportedReduction(f"{op} isn't defined for {dtype}")
    if dtype.kind == "complex":
        return complex(op == "product")
    if op in ("sum", "bit_or"):
        return 0.0 if dtype.kind == "float" else 0
    if op == "product":
        return 1.0 if dtype.kind == "float" else 1
    if dtype.kind == "float":
        return math.inf if op == "min" else -math.inf
    low, high = dtype.limits
    if op == "bit_and":
        return -1 if dtype.kind == "int" else high
    return high if op == "min" else low


def literal(value: object, dtype: ScalarType) -> Column:
    """A cell value as a column of the type's Spark form."""
    if dtype.kind == "complex":
        c = complex(value)  # type: ignore[arg-type]
        return F.struct(F.lit(c.real).alias("re"), F.lit(c.imag).alias("im")).cast(dtype.spark)
    if dtype.name == "Uint64":
        return F.lit(Decimal(int(value))).cast(dtype.spark)  # type: ignore[call-overload]
    return F.lit(value).cast(dtype.spark)


def wrap(value: Column, dtype: ScalarType) -> Column:
    """An exact integer folded into the type's range modulo 2**bits, as narrowing does."""
    low, _ = dtype.limits
    wide = "bigint" if dtype.bits < 64 else "decimal(38,0)"
    span = F.lit(Decimal(1 << dtype.bits)).cast(wide)
    offset = F.lit(Decimal(-low)).cast(wide)
    return (F.pmod(value.cast(wide) + offset, span) - offset).cast(dtype.spark)
