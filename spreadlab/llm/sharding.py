"""Shards by jump consistent hashing: no ring table, only the key and the number of shards.

With one more shard a row either stays or goes to the new one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FACTOR = np.uint64(2862933555777941757)
RANGES = 256
#: A range has about so many rows at most; a table of starts of more rows than the second number is not broadcast.
RANGE_ROWS, BROADCAST_ROWS = 500_000, 1 << 20


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key (Lamping and Veach, 2014)."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key)) if shards > 1 else np.arange(0)
    while len(going):
        key[going] = key[going] * _FACTOR + np.uint64(1)
        to = ((at[going] + 1) * (2147483648.0 / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        stays = to < shards
        going = going[stays]
        at[going] = to[stays]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of an integer key, hashed by the caller where it is anything else; null counts as 0."""

    @F.pandas_udf(T.IntegerType())
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of docs: the id, size (UTF-8 bytes of the text and 16), text_crc32, law "key", shard, slot
    (gapless from 0 in a shard) and grown_shard, where the row is with one more shard.

    A slot is the number of rows in the shard's earlier ranges of ids' MD5, from a first pass that reads only
    ids, plus the place in its own range; so no task orders a whole shard. There are ``ranges`` a shard, by default
    RANGES or as many as RANGE_ROWS asks for; the table of their starts is broadcast up to BROADCAST_ROWS rows. Ids that are no integers count by
    their xxhash64. Null ids all have key 0; null texts have 0 bytes. Repeated ids share a shard and have slots of
    their own. An empty table gives an empty one; other columns don't matter."""
    kind = docs.schema[id_col].dataType
    key = F.col("id") if isinstance(kind, T.IntegralType) else F.xxhash64("id")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ranges is None:
        ranges = max(RANGES, -(-docs.count() // (shards * RANGE_ROWS)))
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")
    span = F.pmod(spread, F.lit(ranges)).cast("int")
    placed = rows.withColumns({"shard": jump_shard(key, shards), "span": span})
    counts = placed.groupBy("shard", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    full = placed.select("id", "shard", "span", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), jump_shard(key, shards + 1).alias("grown_shard"))
    own = Window.partitionBy("shard", "span").orderBy("id", "size", "text_crc32")
    full = full.withColumn("place", F.row_number().over(own) - 1).join(F.broadcast(starts) if shards * ranges <= BROADCAST_ROWS else starts, ["shard", "span"])
    return full.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
