"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the published generator (a fixed value).
JUMP_MULTIPLIER = 2862933555777941757

#: Rows that one ranking bucket of a shard should hold; a task ranks a bucket, never a shard.
BUCKET_ROWS = 50_000


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of every 64-bit key. Each step jumps to a larger shard, so at most ``n_shards`` steps run."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, dtype=np.int64)
    candidate = np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(open_):
            shard[open_] = candidate[open_]
            state[open_] = state[open_] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
            candidate[open_] = np.floor((shard[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            open_ = open_[candidate[open_] < n_shards]
    return shard


def with_shards(df: DataFrame, key: str, n_shards: int, out: str = "shard") -> DataFrame:
    """Adds the shard of ``key`` (a long; null counts as key 0) as an int column ``out``."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).to_numpy(dtype=np.int64), n_shards).astype(np.int32))

    # The key goes to Arrow as it is; a null is replaced before, as a null long would arrive as a double.
    return df.withColumn(out, place(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))))


def assign_shards(docs: DataFrame, n_shards: int, grow_to: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards alone decide, so equal texts with different ids may lie apart.
    ``size`` is the UTF-8 length of the text plus 8. A null text counts as no bytes (size 8, crc 0), as an empty one does.
    A null id is placed as id 0. Repeated rows each get a row and a slot of their own. An empty table gives no rows.
    Slots are gapless from 0 in each shard, ordered by a hash bucket of the id, then by id, crc and size. A bucket holds about
    ``BUCKET_ROWS`` rows, so no task ranks a whole shard. ``grown_shard`` is the place when the shards are ``grow_to``.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = with_shards(with_shards(rows, "doc_id", n_shards), "doc_id", grow_to or n_shards + 1, "grown_shard")
    n_buckets = max(16, -(-docs.count() // (BUCKET_ROWS * n_shards)))
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int"))
    sizes = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "_bucket"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"), "grown_shard"
    )
