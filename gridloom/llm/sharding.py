"""Rendezvous (highest-random-weight) sharding of records over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows that one block of the slot numbering holds on average.
BLOCK_ROWS = 50_000


def _bits(text: Column) -> Column:
    """The first 48 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 48 bits of md5(key ':' shard)."""
    return (_bits(F.concat(key, F.lit(f":{shard}"))).cast("double") + 0.5) / float(1 << 48)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest weight / -ln(u), u drawn from key and shard alone.

    A shard's share of the keys is its share of the weights. A shard more takes rows only into itself,
    and a shard less gives up only its own rows, as every other pair of key and shard keeps its score.
    Shards of weight 0 get nothing; at equal scores the smaller shard wins; a null key counts as ''.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.log(_uniform(key, s)) / F.lit(float(w))).alias("score"), F.lit(-s).alias("less")) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["less"]).cast("int")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `slot`: 0, 1, 2, ... within each shard, without bringing a shard into one task.

    Equal rows are counted first and written out again at the end, block_rows at a time. Different rows are dealt by the md5 of their `order`
    columns over blocks of about block_rows; the rows of a block are numbered by `order`, and a block begins where the blocks before it in
    the shard end. Only one count for each shard and block passes through the running sum. Equal rows get different slots.
    """
    blocks = max(1, -(-df.count() // block_rows))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_block", F.pmod(_bits(key), F.lit(blocks)))
    counts = rows.groupBy(shard, "_block").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard), "_block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("_row", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, [shard, "_block"])
    parts = first.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(block_rows).cast("bigint"))))
    each = F.explode(F.sequence("_part", F.least(F.col("_n"), F.col("_part") + block_rows) - 1))
    return parts.select(*df.columns, "_start", "_row", each.alias("_again")).select(*df.columns, (F.col("_start") + F.col("_row") + F.col("_again")).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """One row for each document with its size, checksum, shard, slot and, if asked for, its shard after growing.

    size is the text's UTF-8 bytes plus 1 (null text: 1) and text_crc32 that of its bytes (null: 0).
    Rows with the same doc_id share a shard and have slots of their own. Other columns of docs don't matter; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous_shard(F.col("doc_id"), weights))
    rows = rows.withColumn("grown_shard", rendezvous_shard(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"))
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document over shards 0 to 15 of equal weight, under the law `key`; grown_shard has 17 shards."""
    out = shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The law in SQL, with CRC-32 (polynomial 0xEDB88320, low bits first) computed from its definition.
ORACLE_SQL = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}::BIGINT) ELSE c >> 1 END)) AS step),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
rows AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, xor({0xFFFFFFFF}::BIGINT, list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM bytes, steps),
drawn AS (
  SELECT *, list_transform(range(17), lambda s: {{'bits': CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, 12) AS BIGINT), 'less': -s}}) AS draws,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size), 1, 12) AS BIGINT) % (SELECT greatest(1, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) FROM documents) AS block
  FROM rows),
placed AS (SELECT *, -list_max(draws[1:16]).less AS shard, -list_max(draws).less AS grown_shard FROM drawn)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(grown_shard AS INT) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM placed
"""
