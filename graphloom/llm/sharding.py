"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and growth moves only what it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U, materialise, mix, numbered

#: Fixed value: the multiplier of the generator in the published algorithm.
STEP = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys in step: each jumps on until it would land behind the last shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(U, copy=True)
    out = np.zeros(len(keys), np.int64)
    alive, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(alive):
        out[alive] = at
        state[alive] = state[alive] * U(STEP) + U(1)
        jump = (out[alive] + 1) * (float(1 << 31) / ((state[alive] >> U(33)) + U(1)).astype(np.float64))
        at = jump.astype(np.int64)
        alive, at = alive[at < shards], at[at < shards]
    return out


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    The law is ``key``: the key and the number of shards decide the shard. ``grown_shard`` is the shard with one more;
    it is either the same or the new one. ``size`` is the UTF-8 bytes of the text (null: none) and 16 more; the null
    text has the CRC of no bytes. ``slot`` numbers the rows of a shard from 0 without gaps. Null keys are one key;
    repeated rows get a slot each. Other columns are not read. No row moves: each task numbers its own rows, and one
    count for each task and shard is gathered.
    """
    schema = pa.schema([("_key", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("grown_shard", pa.int32()), ("local", pa.int64())])

    def run(batches):
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).view(U)
            keys = mix(keys)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shard.astype(np.int32)), pa.array(jump_hash(keys, shards + 1).astype(np.int32)), pa.array(local)], schema=schema)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("_key"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    dealt = materialise(rows.mapInArrow(run, "_key long, size long, text_crc32 long, shard int, grown_shard int, local long").withColumn("part", F.spark_partition_id()))
    return numbered(dealt, "shard", "slot").select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def with_shard(df: DataFrame, keys: list[str], shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of the given key columns of any type."""

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(h.to_numpy().view(U)), shards).astype("int32"))

    return df.withColumn(name, place(F.xxhash64(*keys)))
