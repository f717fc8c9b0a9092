"""How a submission touches an array: read, write or reduce, on a region given by index maps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.geometry import Bounds
from ..plans.mapper import ALL, All, IndexMap, OneToOne, axis, index_map, region
from .arrayframe import ArrayFrame


@dataclass(frozen=True)
class Access:
    """An array with one map for each of its axes; without maps, the whole array."""

    array: ArrayFrame
    maps: tuple = ()
    mode: str = "read"
    op: str | None = None
    private: tuple[IndexMap, ...] = field(default=())

    def __getitem__(self, m: object) -> Access:
        return replace(self, maps=(*self.maps, *(m if isinstance(m, tuple) else (m,))))

    @property
    def clipped(self) -> bool:
        """Regions are clipped to the array, but for one_to_one."""
        return not (len(self.maps) == 1 and isinstance(self.maps[0], OneToOne))

    def resolved(self) -> tuple[IndexMap, ...]:
        """The maps, one for each axis."""
        maps = self.maps
        if len(maps) == 1 and isinstance(maps[0], OneToOne):
            maps = tuple(axis(k) for k in range(self.array.rank))
        elif not maps or (len(maps) == 1 and isinstance(maps[0], All)):
            maps = (ALL,) * self.array.rank
        if len(maps) != self.array.rank:
            raise ValueError(f"{len(maps)} maps for an array of rank {self.array.rank}")
        return tuple(index_map(m) for m in maps)

    def region(self, begin: tuple[int, ...], size: tuple[int, ...]) -> Bounds:
        """The cells that a work chunk touches, clipped to the array. one_to_one isn't clipped: IndexError beyond the array."""
        box = region(self.resolved(), begin, size, tuple(self.array.shape) if self.clipped else None)
        if not Bounds.of(self.array.shape).contains(box):
            raise IndexError("a region isn't inside of the array")
        return box


def _access(a: ArrayFrame | Access) -> Access:
    return a if isinstance(a, Access) else Access(a)


def read(a: ArrayFrame | Access) -> Access:
    return replace(_access(a), mode="read")


def write(a: ArrayFrame | Access) -> Access:
    return replace(_access(a), mode="write")


def privatize(*maps: IndexMap | int) -> tuple[IndexMap, ...]:
    """Axes for which partial results are kept apart until the end. The whole axis (All) can't be one."""
    if any(isinstance(m, All) for m in maps):
        raise ValueError("a private axis needs a bounded map")
    return tuple(index_map(m) for m in maps)


def reduce(op: str, *rest: object) -> Access:
    """reduce(op, array[...]) or reduce(op, privatize(...), array[...])."""
    *private, target = rest
    return replace(_access(target), mode="reduce", op=op, private=tuple(private[0]) if private else ())  # type: ignore[arg-type]


def check_aliases(accesses: list[Access]) -> None:
    """An array that one submission writes or reduces may not appear in it again, nor may a view of it."""
    seen: dict[int, str] = {}
    for a in accesses:
        before = seen.get(id(a.array.root))
        if before is not None and (before != "read" or a.mode != "read"):
            raise RuntimeError("an array that is written may be used only once in a submission")
        seen[id(a.array.root)] = a.mode
