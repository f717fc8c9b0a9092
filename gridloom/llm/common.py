"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of these characters separate words: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Text of ASCII only takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the one that the cluster names in spark.checkpoint.dir.

    Where it is unset a temporary folder serves, but only on a local master; on a cluster no other executor would see it.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_ is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        set_ = spark.sparkContext.getCheckpointDir()
    return set_


_written: list[str] = []


def shared_table(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again, so that later stages don't compute it anew."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shared_tables(spark: SparkSession) -> None:
    """Deletes the tables that shared_table wrote in this process. Call it when the results made from them have been used."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def smallest_hashes(ids: DataFrame, rows: int) -> DataFrame:
    """The rows of ids (doc_id, distinct and not null) with the `rows` smallest hashes of doc_id, in the order of (hash, doc_id).

    A first filter by a threshold from their number leaves about 1.2 times as many (all, where there are not so many), so that little
    is sorted in one task however many partitions there are.
    """
    total = ids.count()
    return under_share(ids, F.lit(1.2 * rows / max(1, total)), rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def under_share(ids: DataFrame, share: Column, rows: int) -> DataFrame:
    # a few hundred are always let through, as the share of small samples varies more
    limit = F.least(F.lit(1.0), share + share * 200 / max(1, rows)) * float(1 << 64) - float(1 << 63)
    return ids.where(F.xxhash64("doc_id").cast("double") <= limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: object, rows: int = 2048, size: int = 2 << 20) -> DataFrame:
    """df.mapInArrow over slices of at most `rows` rows and, but for a single longer one, about `size` bytes: memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, each = 0, rows
            if batch.num_rows:
                each = max(1, min(rows, int(size * batch.num_rows // max(1, batch.nbytes))))
            while start < batch.num_rows:
                part = batch.slice(start, each)
                while part.num_rows > 1 and part.nbytes > 2 * size:
                    part = part.slice(0, part.num_rows // 2)
                yield pa.RecordBatch.from_pydict(kernel(part))
                start += part.num_rows

    return df.mapInArrow(run, schema)


def column_at(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or the field of a struct column as 'column.field'."""
    first, *rest = path.split(".")
    found = batch.column(first)
    for name in rest:
        found = found.field(name)
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts in them (one more entry than rows); nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * at) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The six ASCII characters of white space, by byte.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Sums s[0] b**0 + ... + s[i-1] b**(i-1) modulo 2**64, one more than symbols; span_hash reads them."""
    forward, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * forward, dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's symbols that doesn't depend on where it stands."""
    _, backward = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * backward[starts] + np.uint64(0x51ED270B))


def word_spans(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and how many come before each row; space says which symbols are white space."""
    n = len(space)
    inside = ~space
    start, end = inside.copy(), inside.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
