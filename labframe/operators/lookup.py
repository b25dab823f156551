"""References and natural keys: semi and anti joins over whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labframe.operators.search import active


def known(df: DataFrame, table: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows whose reference exists, active or not."""
    return df.join(table.select(F.col(key).alias(column)), column, "left_semi")


def flagged(df: DataFrame, table: DataFrame, column: str, flag: str, key: str = "id") -> DataFrame:
    """df with a flag: the reference exists."""
    there = table.select(F.col(key).alias(column), F.lit(True).alias(flag)).dropDuplicates([column])
    return df.join(there, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def reference_faults(orders: DataFrame, patients: DataFrame, doctors: DataFrame, items: DataFrame) -> DataFrame:
    """orders with the first fault or null: PATIENT, DOCTOR (if one is given), NO_ITEMS."""
    out = flagged(flagged(orders, active(patients), "patientId", "p"), active(doctors), "doctorId", "d")
    out = out.join(items.select(F.col("serviceOrderId").alias("id")).distinct().withColumn("i", F.lit(True)), "id", "left")
    fault = F.when(~F.col("p"), "PATIENT").when(F.col("doctorId").isNotNull() & ~F.col("d"), "DOCTOR").when(F.col("i").isNull(), "NO_ITEMS")
    return out.withColumn("fault", fault).drop("p", "d", "i")


def study_cardinality(items: DataFrame, studies: DataFrame) -> DataFrame:
    """(serviceOrderId, sent, found, ok): an order that lists a study twice, or an unknown one, is refused."""
    seen = flagged(items.select("serviceOrderId", "studyId"), studies, "studyId", "there")
    out = seen.groupBy("serviceOrderId").agg(F.count("*").alias("sent"), F.count_distinct(F.when(F.col("there"), F.col("studyId"))).alias("found"))
    return out.withColumn("ok", F.col("sent") == F.col("found"))


def exists_by_key(wanted: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """wanted with (exists, id) of the active row of least id; keys with a null part exist nowhere."""
    first = active(table).groupBy(*on).agg(F.min("id").alias("id"))
    return wanted.join(first, on, "left").withColumn("exists", F.col("id").isNotNull())


def conflicts(changes: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Changes (id, key) whose key another row holds, active or not, with the least such row.

    Only the two least holders of a key are needed, which Spark picks before the shuffle; so no key meets itself.
    """
    place = F.row_number().over(Window.partitionBy(*on).orderBy("id"))
    two = table.select("id", *on).withColumn("place", place).where("place <= 2")
    holders = two.groupBy(*on).agg(F.min("id").alias("least"), F.max("id").alias("next"))
    out = changes.join(holders, on).withColumn("other", F.when(F.col("least") != F.col("id"), F.col("least")).otherwise(F.col("next")))
    return out.where(F.col("other") != F.col("id")).select("id", *on, "other").distinct()


def unique_batch(batch: DataFrame, table: DataFrame, on: list[str], sequence: str = "batch_seq") -> DataFrame:
    """The batch with a fault or null: TAKEN (held by any row of the table), REPEATED (an earlier row of the batch has it). Keys with a null part never conflict."""
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    taken = table.select(*on).distinct().withColumn("taken", F.lit(True))
    first = batch.groupBy(*on).agg(F.min(sequence).alias("first"))
    out = batch.join(taken, on, "left").join(first, on, "left")
    return out.withColumn("fault", F.when(whole & F.col("taken"), "TAKEN").when(whole & (F.col(sequence) > F.col("first")), "REPEATED")).drop("taken", "first")


def key_table(table: DataFrame, on: list[str], name: str, buckets: int) -> DataFrame:
    """The keys of a table, kept as a table of their own in buckets by key.

    unique_batch, flagged and exists_by_key meet it where it lies: only the batch is dealt out, to the same buckets, so
    a small batch does not shuffle a large table. Keys of stored batches are added by `key_table_grown`.
    """
    table.select(*on).distinct().write.bucketBy(buckets, *on).sortBy(*on).mode("overwrite").format("parquet").saveAsTable(name)
    return table.sparkSession.table(name)


def key_table_grown(batch: DataFrame, on: list[str], name: str, buckets: int) -> DataFrame:
    """The key table after the keys of a batch that passed unique_batch."""
    batch.select(*on).distinct().write.bucketBy(buckets, *on).sortBy(*on).mode("append").format("parquet").saveAsTable(name)
    return batch.sparkSession.table(name)


def same_parent(df: DataFrame, table: DataFrame, column: str, shared: str) -> DataFrame:
    """Rows whose reference exists under the same parent, and is active if the table says so."""
    there = active(table) if "isActive" in table.columns else table
    return df.join(there.select(F.col("id").alias(column), shared), [column, shared], "left_semi")


def affected(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Requested ids with whether they are there."""
    return flagged(ids, table, "id", "found")


def numbered(df: DataFrame, start: int, order: list, partitions: int | None = None) -> DataFrame:
    """df with dense ids after `start`: ranges are numbered apart after the sizes of those before."""
    from labframe.operators.search import all_pages

    return all_pages(df, order, 1, partitions).withColumn("id", F.col("place") + start + 1).drop("place", "page")


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rank_ = 1").drop("rank_")
