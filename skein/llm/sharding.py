"""Jump consistent hashing: stable keys to shards without a ring table.

`jump_hash` follows the published generator walk (Lamping and Veach): a key's shard for
n + 1 shards is its shard for n, or n. Rows are numbered inside a shard in two levels:
a shard's rows fall into sub-blocks by another hash of the key, block offsets come from
counts, and only a block is sorted at once, so no task takes a whole shard.

Defined cases: a null key hashes as a key of its own; null text counts as no bytes (size
16); repeated rows keep one slot each (order among identical rows is of no effect); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import documents

SHARDS = 40
#: Sub-blocks of a shard. Each holds 1 / (shards * BLOCKS) of the rows.
BLOCKS = 256
ROW_OVERHEAD = 16


def mix64(key: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    z = key + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards of uint64 keys; every lane runs until its own walk has passed the last shard."""
    key = key.astype(np.uint64, copy=True)
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def jump_shard(key_column, shards: int) -> F.Column:
    """Shard of a bigint column."""

    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix64(key.to_numpy(np.int64).view(np.uint64)), shards).astype(np.int32))

    # null is the least number; told before, as pandas would turn a column that holds some into floats
    return of(F.coalesce(F.col(key_column) if isinstance(key_column, str) else key_column, F.lit(-(1 << 63)).cast("long")))


def numbered_in_shards(df: DataFrame, shard: str, block: F.Column, order: list, bounded: bool = True) -> DataFrame:
    """Adds `slot`: 0, 1, 2 ... within each shard, by the counts of sub-blocks (`block`: a number) and an in-block order.

    bounded: the number of shards and sub-blocks does not depend on the data.
    """
    rows = df.withColumn("_block", block.cast("int"))
    counts = rows.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(shard, "_block").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets) if bounded else offsets, [shard, "_block"])
        .withColumn("slot", (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_block", "_base", "_rank")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (see the module's notes)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", jump_shard("doc_id", shards)).withColumn("grown_shard", jump_shard("doc_id", shards + 1))
    block = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % BLOCKS
    rows = numbered_in_shards(rows, "shard", block, ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


SQL = {
    "op2_sharding": r"""
WITH RECURSIVE
tab AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda h, k: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END) AS c FROM range(256) t(i))),
d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, strlen(coalesce(text, '')) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (
  SELECT row, doc_id, size,
         xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda h, b: xor(crc[xor(h & 255, b) + 1], h >> 8))) AS text_crc32,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, b: xor(crc[xor(h & 255, b) + 1], h >> 8))) % 256 AS block
  FROM d, tab),
-- splitmix64 of the id, then the walk of jump consistent hashing for 41 shards; arithmetic modulo 2^64
m1 AS (SELECT row, (CAST(doc_id AS UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM c),
m2 AS (SELECT row, xor(z, z // 1073741824) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM m1),
m3 AS (SELECT row, xor(z, z // 134217728) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM m2),
walk AS (
  SELECT row, xor(z, z // 2147483648) AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM m3
  UNION ALL
  SELECT row, n, j, CAST(trunc((j + 1) * (2147483648.0::DOUBLE / (CAST(n // 8589934592 AS BIGINT) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS n FROM walk WHERE j < 41)),
shards AS (SELECT row, max(b) FILTER (b < 40) AS shard, max(b) FILTER (b < 41) AS grown_shard FROM walk GROUP BY row)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM c JOIN shards USING (row)
""",
}
