"""Ranges, boxes, shapes and points: small values on the driver, and the same rules as columns.

A range is half open. An inverted range is a legal value that is empty; its size is 0. Missing trailing axes of a box are [0, 1),
of a shape 1, of a point 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    begin: int
    end: int

    @classmethod
    def upto(cls, end: int) -> Range:
        return cls(0, end)

    @property
    def is_empty(self) -> bool:
        return self.begin >= self.end

    @property
    def size(self) -> int:
        return max(0, self.end - self.begin)

    def contains(self, other: int | Range) -> bool:
        if isinstance(other, Range):
            return other.is_empty or (self.begin <= other.begin and other.end <= self.end)
        return self.begin <= other < self.end

    def overlaps(self, other: Range) -> bool:
        return not self.intersection(other).is_empty and not self.is_empty and not other.is_empty

    def intersection(self, other: Range) -> Range:
        """May be inverted where the ranges don't meet."""
        return Range(max(self.begin, other.begin), min(self.end, other.end))

    def unite(self, other: Range) -> Range:
        return Range(min(self.begin, other.begin), max(self.end, other.end))

    def split_at(self, mid: int) -> tuple[Range, Range]:
        """Head and tail; mid is clamped into the range."""
        mid = min(max(mid, self.begin), max(self.begin, self.end))
        return Range(self.begin, mid), Range(mid, self.end)

    def shift_by(self, k: int) -> Range:
        return Range(self.begin + k, self.end + k)

    def __str__(self) -> str:
        return f"{self.begin}...{self.end}"


class _Padded(tuple):
    """A tuple whose missing trailing entries have a default; equal across lengths after padding."""

    default: object = None

    def get(self, axis: int) -> object:
        return self[axis] if 0 <= axis < len(self) else self.default

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, type(self)):
            return NotImplemented
        return all(self.get(k) == other.get(k) for k in range(max(len(self), len(other))))

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __hash__(self) -> int:
        n = len(self)
        while n and self[n - 1] == self.default:
            n -= 1
        return hash(tuple(self[:n]))

    @classmethod
    def fill(cls, rank: int, value: int):  # noqa: ANN206
        return cls([value] * rank)

    @classmethod
    def zero(cls, rank: int):  # noqa: ANN206
        return cls.fill(rank, 0)

    @classmethod
    def one(cls, rank: int):  # noqa: ANN206
        return cls.fill(rank, 1)

    @classmethod
    def from_(cls, values: Sequence[int], rank: int | None = None):  # noqa: ANN206
        """From a sequence; with a rank, padded or cut to it as it is (to_rank checks)."""
        out = cls(values)
        return out if rank is None else cls([out.get(k) for k in range(rank)])

    def is_convertible_to(self, rank: int) -> bool:
        """Whether the value fits so many axes: those that go must have the default."""
        return all(x == self.default for x in self[rank:])

    def to_rank(self, rank: int):  # noqa: ANN201
        """The same value with `rank` axes; axes that go must have the default, else ValueError."""
        if not self.is_convertible_to(rank):
            raise ValueError(f"{self!r} doesn't fit rank {rank}")
        return type(self)([self.get(k) for k in range(rank)])


class Dim(_Padded):
    """Sizes."""

    default = 1

    @property
    def is_empty(self) -> bool:
        return any(x <= 0 for x in self)

    @property
    def volume(self) -> int:
        return 0 if self.is_empty else prod(self)

    def contains(self, point: Sequence[int]) -> bool:
        return Bounds.of(self).contains(Point(point))

    def concat(self, other: Dim) -> Dim:
        return Dim([*self, *other])


class Point(_Padded):
    """Coordinates."""

    default = 0

    def concat(self, other: Point) -> Point:
        return Point([*self, *other])


class Bounds(_Padded):
    """A box: a Range for each axis."""

    default = Range(0, 1)

    @classmethod
    def zero(cls, rank: int) -> Bounds:
        return cls.fill(rank, Range(0, 0))  # type: ignore[arg-type]

    @classmethod
    def one(cls, rank: int) -> Bounds:
        return cls.fill(rank, Range(0, 1))  # type: ignore[arg-type]

    @classmethod
    def of(cls, axes: Iterable[int | Range | tuple[int, int]]) -> Bounds:
        return cls(x if isinstance(x, Range) else Range(*x) if isinstance(x, tuple) else Range.upto(x) for x in axes)

    @classmethod
    def from_offset_size(cls, offset: Sequence[int], size: Sequence[int]) -> Bounds:
        return cls(Range(o, o + s) for o, s in zip(offset, size, strict=True))

    @property
    def begin(self) -> Point:
        return Point(r.begin for r in self)

    @property
    def end(self) -> Point:
        return Point(r.end for r in self)

    @property
    def sizes(self) -> Dim:
        return Dim(r.size for r in self)

    @property
    def is_empty(self) -> bool:
        return any(r.is_empty for r in self)

    @property
    def volume(self) -> int:
        return prod(r.size for r in self)

    def _axes(self, other: Bounds) -> list[tuple[Range, Range]]:
        return [(self.get(k), other.get(k)) for k in range(max(len(self), len(other)))]  # type: ignore[misc]

    def intersection(self, other: Bounds) -> Bounds:
        return Bounds(a.intersection(b) for a, b in self._axes(other))

    def unite(self, other: Bounds) -> Bounds:
        """The smallest box around both, also of empty boxes."""
        return Bounds(a.unite(b) for a, b in self._axes(other))

    def overlaps(self, other: Bounds) -> bool:
        return all(a.overlaps(b) for a, b in self._axes(other))

    def contains(self, other: Bounds | Point) -> bool:
        if isinstance(other, Bounds):
            return other.is_empty or all(a.contains(b) for a, b in self._axes(other))
        return all(self.get(k).contains(other.get(k)) for k in range(max(len(self), len(other))))  # type: ignore[attr-defined]

    def shift_by(self, offset: Sequence[int]) -> Bounds:
        return Bounds(r.shift_by(Point(offset).get(k)) for k, r in enumerate(self))  # type: ignore[arg-type]

    def split_along(self, axis: int, mid: int) -> tuple[Bounds, Bounds]:
        """Head and tail; for an axis that isn't there the whole box and an empty one."""
        if not 0 <= axis < len(self):
            return self, Bounds(Range(0, 0) for _ in self)
        head, tail = self[axis].split_at(mid)
        return Bounds([*self[:axis], head, *self[axis + 1 :]]), Bounds([*self[:axis], tail, *self[axis + 1 :]])

    def concat(self, other: Bounds) -> Bounds:
        return Bounds([*self, *other])


# ---- the same rules as columns: a range is struct<begin, end>, a box an array of them


def range_struct(begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"))


def range_size(r: Column) -> Column:
    return F.greatest(r["end"] - r["begin"], F.lit(0).cast("bigint"))


def range_is_empty(r: Column) -> Column:
    return r["begin"] >= r["end"]


def range_contains(r: Column, index: Column) -> Column:
    return (index >= r["begin"]) & (index < r["end"])


def range_contains_range(r: Column, other: Column) -> Column:
    return range_is_empty(other) | ((r["begin"] <= other["begin"]) & (other["end"] <= r["end"]))


def range_overlaps(a: Column, b: Column) -> Column:
    return ~range_is_empty(a) & ~range_is_empty(b) & (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def range_intersection(a: Column, b: Column) -> Column:
    return range_struct(F.greatest(a["begin"], b["begin"]), F.least(a["end"], b["end"]))


def range_unite(a: Column, b: Column) -> Column:
    return range_struct(F.least(a["begin"], b["begin"]), F.greatest(a["end"], b["end"]))


def range_split(r: Column, mid: Column) -> tuple[Column, Column]:
    m = F.least(F.greatest(mid.cast("bigint"), r["begin"]), F.greatest(r["begin"], r["end"]))
    return range_struct(r["begin"], m), range_struct(m, r["end"])


def range_shift(r: Column, k: Column) -> Column:
    return range_struct(r["begin"] + k, r["end"] + k)


def bounds_axis(b: Column, axis: int) -> Column:
    return F.coalesce(F.get(b, F.lit(axis)), range_struct(F.lit(0), F.lit(1)))


def bounds_volume(b: Column) -> Column:
    return F.aggregate(b, F.lit(1).cast("bigint"), lambda acc, r: acc * range_size(r))


def _padded(a: Column, b: Column, join) -> Column:  # noqa: ANN001
    unit = range_struct(F.lit(0), F.lit(1))
    return F.zip_with(a, b, lambda x, y: join(F.coalesce(x, unit), F.coalesce(y, unit)))


def bounds_intersection(a: Column, b: Column) -> Column:
    return _padded(a, b, range_intersection)


def bounds_unite(a: Column, b: Column) -> Column:
    return _padded(a, b, range_unite)


def bounds_overlaps(a: Column, b: Column) -> Column:
    return F.forall(_padded(a, b, range_overlaps), lambda x: x)


def bounds_contains(a: Column, b: Column) -> Column:
    return F.exists(b, range_is_empty) | F.forall(_padded(a, b, range_contains_range), lambda x: x)
