"""Sharding by jump consistent hashing (law `key`).

A key jumps from shard to shard through a fixed pseudo-random sequence until
the next jump leaves the shard count, so the key and the count alone decide,
no table is kept, and one more shard takes over only the rows that move into
it. Slots number a shard's rows from 0 without gaps, in order of doc_id, then
checksum; rows equal in both are in any order.

Null doc_id counts as key 0, null text as no bytes (size 16, checksum 0). Rows
with the same doc_id share a shard. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.numbering import with_slots

_STEP = np.uint64(2862933555777941757)  # the published generator's multiplier


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64)
    shard, following = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        shard[open_] = following[open_]
        key[open_] = key[open_] * _STEP + np.uint64(1)
        scale = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1)
        following[open_] = ((shard[open_] + 1) * scale).astype(np.int64)
        open_ = open_[following[open_] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(0)).cast("long"))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    return with_slots(placed, "shard", ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
