"""Sharding by jump consistent hashing: the key and the shard count decide, and there is no ring table.

With one more shard a key either stays or moves to the new shard, so an appended shard takes its fraction of the
rows and nothing else moves (law `key`). Slots number a shard's rows without gaps. They come from counts of blocks
of a shard, so no task holds a whole shard: rows of a block are numbered from the sum of the blocks before it. A block
is what one partition of the table holds of a shard, so it is never larger than that, however often a key repeats.

Defined results: a null text has size 16 and the checksum of no bytes; a null key counts as one key of its own;
repeated rows keep their number and get different slots; other columns are not looked at; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.llm.common import broadcast_if_small, guarded, stored

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Fixed values of jump consistent hashing (Lamping and Veach, 2014): the multiplier of its 64-bit generator and 2^31.
MULTIPLIER, SPAN = 2862933555777941757, 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys leap at once, until none is below the shard count."""
    state = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        while (live := ahead < shards).any():
            at[live] = ahead[live]
            state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[live] = ((at[live] + 1) * (SPAN / draw)).astype(np.int64)
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type, which Spark's 64-bit hash spreads first."""

    @F.pandas_udf("int")
    def leap(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards))

    return leap(F.xxhash64(key))


def sharded(df: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of df."""
    guarded(df.columns, [id_column, text], "sharded")
    raw = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(id_column), (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), shard_of(F.col(id_column), shards).alias("shard"), shard_of(F.col(id_column), shards + 1).alias("grown_shard")]
    rows = stored(df.select(*columns, F.spark_partition_id().alias("block")), "shards")
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy(id_column, "text_crc32")
    placed = rows.withColumn("place", F.row_number().over(inside) - 1).join(broadcast_if_small(first), ["shard", "block"])
    return placed.select(id_column, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("bigint").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 40, id_column: str = "doc_id", max_records: int = 100_000) -> None:
    """Writes df as Parquet with one folder a shard; files hold at most max_records rows, so a large shard has many."""
    df.withColumn("shard", shard_of(F.col(id_column), shards)).write.partitionBy("shard").option("maxRecordsPerFile", max_records).parquet(path)
