"""Index domains cut into tiles, and the regular grid of chunks that an array is stored in."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Bounds, Dim
from ..functions.scalar import div_floor, div_trunc

#: A work domain has three axes; missing ones have size 1.
AXES = 3


def tile_domain(spark: SparkSession, size: Sequence[int], tile: Sequence[int], owners: int | Sequence[int] = 1, space: str = "device") -> DataFrame:
    """Chunks (chunk_id, owner, o0..o2, s0..s2) of a domain. The first axis runs fastest, last tiles are clipped, owners (a number of them, or a list) take turns.

    An empty domain has no chunks. Tiles must be positive. In the device space there must be a device to own chunks; the host space has
    one owner for each device that is near it, and a single one without devices.
    """
    if space not in ("device", "host"):
        raise ValueError(f"unknown space {space}")
    named = list(range(owners)) if isinstance(owners, int) else list(owners)
    named = named or ([0] if space == "host" else [])
    size, tile = ([*x, *[1] * (AXES - len(x))] for x in (size, tile))
    if any(t <= 0 for t in tile):
        raise ValueError("tiles must have positive sizes")
    if not named:
        raise ValueError("there is no resource to own the chunks")
    counts = [max(0, -(-s // t)) for s, t in zip(size, tile, strict=True)]
    rows, step, columns = spark.range(prod(counts)).withColumnRenamed("id", "chunk_id"), 1, []
    for k in range(AXES):
        offset = div_trunc(F.col("chunk_id"), F.lit(step)) % F.lit(max(1, counts[k])) * F.lit(tile[k])
        columns.append((offset.cast("bigint"), F.least(F.lit(tile[k]), F.lit(size[k]) - offset).cast("bigint")))
        step *= max(1, counts[k])
    return rows.select("chunk_id", F.get(F.array(*(F.lit(o) for o in named)), (F.col("chunk_id") % len(named)).cast("int")).alias("owner"), *(o.alias(f"o{k}") for k, (o, _) in enumerate(columns)), *(s.alias(f"s{k}") for k, (_, s) in enumerate(columns)))


def into_domain(spark: SparkSession, domain: object) -> DataFrame:
    """A chunk table as it is, anything with to_domain(spark), or (size, tile[, owners])."""
    if isinstance(domain, DataFrame):
        return domain
    if hasattr(domain, "to_domain"):
        return domain.to_domain(spark)
    return tile_domain(spark, *domain)  # type: ignore[misc]


class Distribution:
    """An array of some shape in chunks of one size, numbered in row-major order; the last chunk of an axis may be shorter."""

    def __init__(self, shape: Sequence[int], chunk: Sequence[int], owners: Sequence[int] | None = None) -> None:
        self.shape, self.chunk = Dim(shape), Dim(chunk)
        if len(shape) != len(chunk) or any(c <= 0 for c in chunk):
            raise ValueError("chunk sizes must be positive, one for each axis")
        self.counts = tuple(max(0, -(-s // c)) for s, c in zip(shape, chunk, strict=True))
        if owners is not None and len(owners) != self.num_chunks:
            raise ValueError(f"{self.num_chunks} chunks, but {len(owners)} owners")
        self.owners = tuple(owners) if owners is not None else None

    @property
    def num_chunks(self) -> int:
        return prod(self.counts)

    def chunk_bounds(self, index: int) -> Bounds:
        if not 0 <= index < self.num_chunks:
            raise IndexError(f"chunk {index} of {self.num_chunks}")
        place = []
        for n in reversed(self.counts):
            place.append(index % n)
            index //= n
        return Bounds.of((p * c, min(s, (p + 1) * c)) for p, c, s in zip(reversed(place), self.chunk, self.shape, strict=True))

    def chunk_of_region(self, box: Bounds) -> int:
        """The chunk that a region lies in; IndexError where it is outside of the array or crosses chunks."""
        if not Bounds.of(self.shape).contains(box):
            raise IndexError("the region isn't inside of the array")
        index = 0
        for r, c, n in zip(box, self.chunk, self.counts, strict=True):
            if not r.is_empty and r.begin // c != (r.end - 1) // c:
                raise IndexError("the region lies in more than one chunk")
            index = index * n + r.begin // c
        return index

    def chunk_id(self, coordinates: Sequence[Column]) -> Column:
        """The chunk number of a cell as a column."""
        out = F.lit(0).cast("bigint")
        for d, c, n in zip(coordinates, self.chunk, self.counts, strict=True):
            out = out * n + div_floor(d, F.lit(c))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(chunk_id, o0.., s0..) of all chunks."""
        columns, step = [], self.num_chunks
        for k, (c, n, s) in enumerate(zip(self.chunk, self.counts, self.shape, strict=True)):
            step = step // n if n else 1
            o = (div_trunc(F.col("chunk_id"), F.lit(max(1, step))) % F.lit(max(1, n)) * F.lit(c)).cast("bigint")
            columns.append((k, o, F.least(F.lit(c), F.lit(s) - o).cast("bigint")))
        return spark.range(self.num_chunks).withColumnRenamed("id", "chunk_id").select("chunk_id", *(o.alias(f"o{k}") for k, o, _ in columns), *(s.alias(f"s{k}") for k, _, s in columns))

    @classmethod
    def from_chunks(cls, shape: Sequence[int], chunks: Sequence[tuple[int, Sequence[int], Sequence[int]]], allow_duplicates: bool = False) -> Distribution:
        """From (owner, offset, size) of each chunk, in any order.

        The chunk at the origin gives the size. Every chunk must be aligned and of that size (or clipped), and they must cover the array.
        Two chunks at one place are an error unless allowed; if their owners differ, the host (owner -1) gets the place.
        """
        rank = len(shape)
        if not chunks:
            if Dim(shape).is_empty:
                return cls(shape, [1] * rank, [])
            raise ValueError("no chunks")
        origin = [tuple(s) for _, o, s in chunks if all(x == 0 for x in o)]
        if not origin:
            raise ValueError("no chunk at the origin")
        size = origin[0]
        if any(x <= 0 for x in size):
            raise ValueError("chunk size is empty")
        grid = cls(shape, size)
        owner_of: dict[int, int] = {}
        for owner, offset, extent in chunks:
            if any(o % c for o, c in zip(offset, size, strict=True)):
                raise ValueError(f"chunk at {tuple(offset)} isn't aligned")
            index = grid.chunk_of_region(Bounds.from_offset_size(offset, [1] * rank))
            if grid.chunk_bounds(index) != Bounds.from_offset_size(offset, extent):
                raise ValueError(f"chunk at {tuple(offset)} has the wrong size")
            if index in owner_of:
                if not allow_duplicates:
                    raise ValueError(f"two chunks at {tuple(offset)}")
                owner = owner if owner_of[index] == owner else -1
            owner_of[index] = owner
        if len(owner_of) != grid.num_chunks:
            raise ValueError(f"{grid.num_chunks - len(owner_of)} chunks are missing")
        return cls(shape, size, [owner_of[k] for k in range(grid.num_chunks)])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Distribution) and (self.shape, self.chunk, self.owners) == (other.shape, other.chunk, other.owners)

    __hash__ = None  # type: ignore[assignment]
