"""Helpers that the training-data operators share: the shared folder, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a side that is broadcast (a few 8-byte columns a row); larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/labframe-{spark.sparkContext.applicationId}"
    files, there = _file_system(spark, folder)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing will read again."""
    for path in paths:
        files, there = _file_system(spark, path)
        files.delete(there, True)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to a table in the shared folder and read again, which cuts its lineage and outlives lost executors.

    The tables of an application lie in one folder, which goes when the application ends; `discarded` drops one earlier.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def stored_as(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, a view of some columns of a stored table, in whose place it is discarded."""
    _PATHS[df] = _PATHS.pop(table)
    return df


def discarded(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        files, path = _file_system(df.sparkSession, _PATHS.pop(df))
        files.delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted and has at most `limit` rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.count() <= limit else df


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is merged: Spark takes what an explode, arrays or compressed files make for smaller than it is, and would send it to the driver."""
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; the built-in lower() does just that where every character takes one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def by_bytes(batches: Iterable[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches dealt out anew, so that each holds at most `limit` bytes of a string column, or one row; short ones are put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + limit - size, "right"))
            if stop <= start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of undirected edges, component being the smallest node reached.

    Every node points at a smaller one of its component. In a round it looks at where its neighbours' pointers point:
    the least such node becomes its own pointer and, if smaller, that of the node it pointed at, so whole trees are
    hung up at once; and pointers are followed one step further. Distances shrink by a factor in each round, so rounds
    grow with the logarithm of the longest path (a path of 5,000 nodes takes 14, one of 100,000 takes 20); they end when
    no pointer moves, and there is no other bound. Minima combine before the shuffle, so a hub is no hot task.
    Pointers are kept in a table of the shared folder; the driver only learns whether one moved.
    """
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")), "labels")
    while True:
        further = labels.toDF("parent", "further")
        known = labels.withColumnRenamed("component", "parent").join(merged(further), "parent")
        near = both.join(merged(known.select(F.col("node").alias("y"), "further")), "y").groupBy(F.col("x").alias("node")).agg(F.min("further").alias("near"))
        seen = known.join(merged(near), "node")
        own = seen.select("node", F.least("further", "near").alias("component"), F.col("parent").alias("was"))
        hung = seen.where("near < further").select(F.col("parent").alias("node"), F.col("near").alias("component"), F.lit(None).cast(own.schema["was"].dataType).alias("was"))
        new = stored(own.unionByName(hung).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was")), "labels")
        discarded(labels)
        labels = stored_as(new.select("node", "component"), new)
        if not new.where("component <> was").limit(1).count():
            discarded(both)
            return labels


def guarded(columns: Iterable[str], needed: Iterable[str], op: str) -> None:
    missing = [c for c in needed if c not in set(columns)]
    if missing:
        raise ValueError(f"{op}: the table lacks {', '.join(missing)}")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
