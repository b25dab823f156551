"""Several tables changed by one commit: data first, then one small manifest that makes all of it visible at once.

A batch writes its rows to folders of its own, which no reader looks at, and then publishes them by moving a manifest
to the next free version number; the move fails if another writer has taken that number, and is tried with the one
after. Readers take the manifests in order. So a run that is killed before the move leaves the old state readable, and
one that is repeated under the same batch id changes nothing.

    root/_versions/00000000000000000003.json   {"batch": "orders-17", "tables": {"orders": {"path": ..., "mode": "append", "schema": ...}}}
    root/orders/orders-17-<uuid>/part-...      the batch's rows
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Digits of a version's file name, and tries to find a free one.
DIGITS, TRIES = 20, 100


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(conf), found


def versions(spark: SparkSession, root: str) -> list[dict]:
    """The manifests in order."""
    files, folder = _files(spark, f"{root}/_versions")
    if not files.exists(folder):
        return []
    names = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))
    if not names:
        return []
    # one small text for each version, read by the driver alone
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    out = []
    for name in names:
        stream = files.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name))
        try:
            out.append(json.loads(read.toString(stream, "UTF-8")))
        finally:
            stream.close()
    return out


def _published(spark: SparkSession, root: str, manifest: dict, at: int) -> bool:
    """Whether the manifest got the version number `at`."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, folder = _files(spark, f"{root}/_versions")
    files.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{at:0{DIGITS}d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), options)
    except Exception as e:  # another writer has this number
        files.delete(draft, False)
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def committed(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame], replace: tuple[str, ...] = (), before_publishing: Callable[[], None] = lambda: None) -> bool:
    """Makes all rows of a batch visible at once: appended to their tables, or in their place for those of `replace`.

    Returns whether anything changed: a batch id that is published already is left alone.
    """
    if any(v["batch"] == batch for v in versions(spark, root)):
        return False
    parts = {}
    for name, df in tables.items():
        path = f"{root}/{name}/{batch}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        parts[name] = {"path": path, "mode": "replace" if name in replace else "append", "schema": df.schema.json()}
    before_publishing()
    for _ in range(TRIES):
        known = versions(spark, root)
        if any(v["batch"] == batch for v in known):
            return False
        if _published(spark, root, {"batch": batch, "tables": parts}, len(known)):
            return True
    raise RuntimeError(f"no free version for batch {batch}")


def read_published(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The table as of the last version, or of an earlier one (counted from 0)."""
    parts: list[dict] = []
    for v in versions(spark, root)[: None if version is None else version + 1]:
        if part := v["tables"].get(table):
            parts = [part] if part["mode"] == "replace" else [*parts, part]
    if not parts:
        raise ValueError(f"no version of {table} is published in {root}")
    schema = T.StructType.fromJson(json.loads(parts[-1]["schema"]))
    return spark.read.schema(schema).parquet(*(p["path"] for p in parts))


def swept(spark: SparkSession, root: str) -> int:
    """Deletes folders of batches that were never published, when no writer is at work, and returns how many."""
    known = {p["path"].rstrip("/").rpartition("/")[2] for v in versions(spark, root) for p in v["tables"].values()}
    files, folder = _files(spark, root)
    gone = 0
    for table in files.listStatus(folder) if files.exists(folder) else []:
        if table.getPath().getName().startswith("_"):
            continue
        for part in files.listStatus(table.getPath()):
            if part.getPath().getName() not in known:
                files.delete(part.getPath(), True)
                gone += 1
    return gone


def commit_sink(stream: DataFrame, root: str, name: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]]):
    """A writer that commits each micro-batch under its number, so that a batch which is run again after a restart changes nothing."""

    def put(df: DataFrame, number: int) -> None:
        committed(df.sparkSession, root, f"{name}-{number}", tables(df))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
