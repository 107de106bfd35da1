"""Sharding by jump consistent hashing (DataFrame functions only).

The shard of a document depends on its id and the number of shards alone: the id seeds the published
64-bit congruential generator, each draw jumps to the next shard number that would take the key, and
the last one below the number of shards is the shard.  There is no ring table; with one more shard,
keys move only into the new one.

The generator's products modulo 2**64 are taken in limbs of 22, 22 and 20 bits, whose products and
sums fit a signed 64-bit integer.

Slots number a shard's rows from 0 without gaps.  A plain row_number over a shard would sort it in
one task; instead each shard is numbered in blocks (by id modulo the number of blocks), and a block
starts where the counts of the earlier blocks of its shard end.  Those counts read ids alone.

Defined cases: a null id counts as key 0; null text has no bytes (size 8) and a null CRC; rows that
repeat an id land in one shard and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bounded_broadcast, materialise

SHARDS = 24
#: Bytes counted for each row besides its text.
ROW_BYTES = 8
#: Blocks that each shard's rows are numbered in, at least, and rows of a shard that a block should hold.
BLOCKS = 64
BLOCK_ROWS = 1_000_000

#: Fixed values of the published generator: next key = key * MULTIPLIER + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757

_LOW22 = (1 << 22) - 1
_M0, _M1, _M2 = MULTIPLIER & _LOW22, (MULTIPLIER >> 22) & _LOW22, MULTIPLIER >> 44


def jump_hash(key: Column, shards: int) -> Column:
    """Shard number from 0 to ``shards`` - 1 of a 64-bit integer key.  Each jump goes up by one
    at least, so as many steps as there are shards always suffice."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(_LOW22).alias("k0"),
        F.shiftright(key, 22).bitwiseAND(_LOW22).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(a: Column, _: Column) -> Column:
        t0 = a["k0"] * F.lit(_M0).cast("long") + 1
        t1 = a["k0"] * F.lit(_M1).cast("long") + a["k1"] * F.lit(_M0).cast("long") + F.shiftright(t0, 22)
        t2 = a["k0"] * F.lit(_M2).cast("long") + a["k1"] * F.lit(_M1).cast("long") + a["k2"] * F.lit(_M0).cast("long") + F.shiftright(t1, 22)
        k0, k1, k2 = t0.bitwiseAND(_LOW22), t1.bitwiseAND(_LOW22), t2.bitwiseAND((1 << 20) - 1)
        top31 = F.shiftleft(k2, 11) + F.shiftright(k1, 11)
        to = F.floor((a["next"] + 1).cast("double") * (F.lit(2147483648.0) / (top31 + 1).cast("double"))).cast("long")
        go = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), a["next"].alias("shard"), to.alias("next"))
        return F.when(a["next"] < shards, go).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda a: a["shard"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, carry: Column | None = None) -> DataFrame:
    """``row`` (struct of all columns, or what ``carry`` gives), bytes, text_crc32, shard,
    grown_shard and slot of each document.  Only what is carried goes through the shuffle."""
    blocks = max(BLOCKS, -(-docs.count() // (shards * block_rows)))
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.col("doc_id") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    crc = F.crc32(F.encode("text", "UTF-8"))
    mixed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc.cast("string")))
    block = F.pmod(F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    shard = jump_hash(key, shards)
    counts = docs.select(shard.alias("shard"), block.alias("block")).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    placed = docs.select(
        (F.struct("*") if carry is None else carry).alias("row"),
        F.col("doc_id").alias("id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        crc.alias("text_crc32"),
        shard.alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        block.alias("block"),
    )
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "bytes"))
    joined = placed.withColumn("number", number).join(bounded_broadcast(starts), ["shard", "block"])
    return joined.select("row", "bytes", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("number") - 1).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    placed = shard_documents(docs.select("doc_id", "text"), carry=F.struct("doc_id"))
    return placed.select("row.doc_id", (F.col("bytes") + ROW_BYTES).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


SQL = f"""
WITH RECURSIVE j AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS key, (CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END + coalesce(doc_id, 0))::HUGEINT AS k, 0::BIGINT AS pos FROM documents
  UNION ALL
  SELECT key, (k * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT,
         floor((pos + 1)::DOUBLE * (2147483648.0::DOUBLE / (((k * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM j WHERE pos <= {SHARDS}),
s AS (SELECT key, max(pos) FILTER (pos < {SHARDS})::INT AS shard, max(pos) FILTER (pos < {SHARDS} + 1)::INT AS grown_shard FROM j GROUP BY key),
b AS (SELECT doc_id, text, coalesce(strlen(text), 0)::BIGINT AS bytes, encode(nullif(text, ''))::BIT AS bits FROM documents),
c AS (SELECT *, CASE WHEN text = '' THEN 0::BIGINT WHEN text IS NOT NULL THEN xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(8 * bytes), lambda i: get_bit(bits, (i // 8 * 8 + 7 - i % 8)::INT)::BIGINT)),
        lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295::BIGINT) END AS text_crc32 FROM b)
SELECT doc_id, bytes + {ROW_BYTES} AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || coalesce(':' || text_crc32, '')), 1, 8))::BIGINT % {BLOCKS}, doc_id NULLS FIRST, text_crc32 NULLS FIRST, bytes) - 1 AS slot, grown_shard
FROM c JOIN s ON coalesce(doc_id, 0) = key
"""
