"""Affine index maps: which interval of an array axis a work chunk touches.

A map is (scale * axis + offset + [0, length)) / divisor. They are small values on the driver; `apply` turns one into begin and end columns
over a chunk table, so that the region becomes an ordinary range predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Range
from ..functions.scalar import div_trunc


@dataclass(frozen=True)
class IndexMap:
    """The map of one array axis. `axis` is the axis of the work domain; scale 0 makes it a constant."""

    axis: int = 0
    scale: int = 1
    offset: int = 0
    length: int = 1
    divisor: int = 1

    def __post_init__(self) -> None:
        if self.divisor == 0:
            raise ZeroDivisionError("divisor is zero")
        scale, offset, length, divisor = self.scale, self.offset, max(0, self.length), self.divisor
        if divisor < 0:
            scale, offset, divisor = -scale, -(offset + length - 1), -divisor
        if scale != 1 and divisor != 1:
            common = gcd(gcd(scale, offset), gcd(length, divisor))
            if common > 1 and length % common == 0 and offset % common == 0:
                scale, offset, length, divisor = scale // common, offset // common, length // common, divisor // common
        for name, value in (("scale", scale), ("offset", offset), ("length", length), ("divisor", divisor)):
            if not -(1 << 63) <= value < 1 << 63:
                raise OverflowError(f"{name} doesn't fit 64 bits")
            object.__setattr__(self, name, value)

    def __add__(self, c: int) -> IndexMap:
        return replace(self, offset=self.offset + self.divisor * c)

    __radd__ = __add__

    def __pos__(self) -> IndexMap:
        return self

    def __neg__(self) -> IndexMap:
        return replace(self, scale=-self.scale, offset=-(self.offset + self.length - 1))

    def __sub__(self, c: int) -> IndexMap:
        return self + -c

    def __rsub__(self, c: int) -> IndexMap:
        return -self + c

    def __mul__(self, c: int) -> IndexMap:
        if c < 0:
            return -self * -c
        return replace(self, scale=self.scale * c, offset=self.offset * c, length=(self.length - 1) * c + 1)

    __rmul__ = __mul__

    def __floordiv__(self, c: int) -> IndexMap:
        return replace(self, divisor=self.divisor * c)

    __truediv__ = __floordiv__

    def interval(self, begin: int, size: int) -> Range:
        """The interval for a chunk [begin, begin + size) of the axis. Quotients round toward zero, as in the SQL form."""
        if self.scale == 0:
            b, n = self.offset, self.length
        elif self.length <= 0 or size <= 0:
            b, n = 0, 0
        elif self.scale > 0:
            b, n = self.scale * begin + self.offset, self.scale * (size - 1) + self.length
        else:
            b, n = self.scale * (begin + size - 1) + self.offset, -self.scale * (size - 1) + self.length
        if self.divisor > 1:
            q = abs(b) // self.divisor * (1 if b >= 0 else -1)
            r = b - q * self.divisor
            b, n = q, max(0, (n + r + self.divisor - 1)) // self.divisor
        return Range(b, b + n)

    def apply(self, begin: Column, size: Column) -> tuple[Column, Column]:
        """Begin and end of the interval as columns."""
        begin, size = begin.cast("bigint"), size.cast("bigint")
        if self.scale == 0:
            b, n = F.lit(self.offset).cast("bigint"), F.lit(self.length).cast("bigint")
        else:
            edge = begin if self.scale > 0 else begin + size - 1
            some = (size > 0) & F.lit(self.length > 0)
            b = F.when(some, edge * self.scale + self.offset).otherwise(F.lit(0).cast("bigint"))
            n = F.when(some, (size - 1) * abs(self.scale) + self.length).otherwise(F.lit(0).cast("bigint"))
        if self.divisor > 1:
            d = F.lit(self.divisor).cast("bigint")
            b, n = div_trunc(b, d), F.greatest(F.lit(0), div_trunc(n + b % d + d - 1, d))
        return b, b + n

    def __str__(self) -> str:
        name = "xyz"[self.axis] if self.axis < 3 else f"axis{self.axis}"
        term = "" if self.scale == 0 else name if self.scale == 1 else f"{self.scale}*{name}"
        last = self.offset + self.length - 1
        low = f"{term} + {self.offset}" if term and self.offset else term or str(self.offset)
        text = low if self.length == 1 else f"{low}...{last + 1 if not term else f'{term} + {last + 1}'}"
        return f"({text})/{self.divisor}" if self.divisor > 1 else text


def axis(k: int) -> IndexMap:
    return IndexMap(k)


@dataclass(frozen=True)
class All:
    """The whole axis, or the whole array."""

    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class OneToOne:
    """The chunk's own box, not clipped to the array."""


ALL, ONE_TO_ONE = All(), OneToOne()


def index_map(m: int | IndexMap | All) -> IndexMap:
    """Integers are the constant [m, m + 1), All is everything from 0 on (to be clipped)."""
    if isinstance(m, IndexMap):
        return m
    if isinstance(m, All):
        return IndexMap(0, 0, 0, (1 << 63) - 1)
    return IndexMap(0, 0, int(m), 1)


def span(a: int | IndexMap, b: int | IndexMap | None = None) -> IndexMap:
    """From a up to b: for numbers half open, for maps including all that b covers."""
    if isinstance(a, IndexMap) or isinstance(b, IndexMap):
        a, b = index_map(a), index_map(b)  # type: ignore[arg-type]
        if (a.axis, a.scale, a.divisor) != (b.axis, b.scale, b.divisor):
            raise ValueError("both ends must have the same axis, scale and divisor")
        return replace(a, length=b.offset - a.offset + b.length)
    low, high = (0, a) if b is None else (a, b)
    return IndexMap(0, 0, low, high - low)


def tile(*lengths: int) -> tuple[IndexMap, ...]:
    """Chunk [o, o + s) of axis k touches [l o, l (o + s))."""
    return tuple(IndexMap(k, n, 0, n) for k, n in enumerate(lengths))


def region(maps: tuple, begin: tuple[int, ...], size: tuple[int, ...], clip: tuple[int, ...] | None = None) -> Bounds:
    """The box that maps give for one chunk, clipped to sizes where given."""
    at = lambda x, k: x[k] if k < len(x) else (0 if x is begin else 1)
    box = Bounds(m.interval(at(begin, m.axis), at(size, m.axis)) for m in map(index_map, maps))
    return box if clip is None else box.intersection(Bounds.of(clip))
