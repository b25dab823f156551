"""Listing and searching: filters, sorts, pages, totals, expansion of nested rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.operators import textindex
from labframe.sources.io import stored

#: Rows that one range of all_pages aims at.
RANGE_ROWS = 1_000_000


def active(df: DataFrame) -> DataFrame:
    return df.where("isActive")


def contains(q: str | None, columns: Sequence[str | Column]) -> Column:
    """Some column contains q, by case; % and _ in q are wildcards, a backslash is itself. Without q: true."""
    if not q:
        return F.lit(True)
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return reduce(lambda a, b: a | b, [(F.col(c) if isinstance(c, str) else c).like(pattern) for c in columns])


def equal_to(**wanted: object) -> Column:
    """All given values match; those that are empty are not asked for."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v], F.lit(True))


def between(column: str, low: str | None, high: str | None) -> Column:
    """Both ends included, and both needed: with one missing there is no condition. A date means its midnight."""
    if not low or not high:
        return F.lit(True)
    return F.col(column).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))


def keys(*columns: str, tie: str = "id") -> list[Column]:
    """Sort keys with nulls last going up and first going down (a column with a leading minus), and a tie-break."""
    out = [F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
    return [*out, F.col(tie).asc_nulls_last()]


def page(df: DataFrame, order: Sequence[Column], number: int | None = 1, size: int | None = 10) -> DataFrame:
    """One page: a top-k, not a full sort. Missing numbers take their defaults."""
    number, size = number or 1, size or 10
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and hold at least one row")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def total(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.count_distinct(key).alias("total"))


def all_pages(df: DataFrame, order: Sequence[Column], size: int, partitions: int | None = None) -> DataFrame:
    """Every row with its page and place. Ranges of about RANGE_ROWS rows are numbered apart, after the sizes of the ranges before them.

    The driver only learns the number of rows in each range; there is no window over the whole table.
    """
    if not partitions:
        df = stored(df, "rows")  # counted, sampled for its ranges and dealt out: computed once
        partitions = max(8, -(-df.count() // RANGE_ROWS))
    ranged = stored(df.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before, start = [], 0
    for r in ranged.groupBy("range").count().orderBy("range").toLocalIterator():
        before.append((r["range"], start))
        start += r["count"]
    ahead = df.sparkSession.createDataFrame(before, "range int, before bigint")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    out = ranged.join(ahead, "range").withColumn("place", place.cast("bigint"))
    return out.withColumn("page", F.floor(F.col("place") / size).cast("bigint") + 1).select(*df.columns, "place", "page")


def top_of_terms(df: DataFrame, terms: DataFrame, columns: Sequence[str], order: Sequence[Column], k: int, index: DataFrame | None = None) -> DataFrame:
    """The first k matches of each term (term_id, q), found by an index of the columns (see textindex), which is built if none is given."""
    found = textindex.matches(df, stored(textindex.text_index(df, columns), "index") if index is None else index, terms, columns)
    return df.join(found, "id").withColumn("place", F.row_number().over(Window.partitionBy("term_id").orderBy(*order))).where(F.col("place") <= k)


def first_by_key(wanted: DataFrame, df: DataFrame, on: list[str], tie: str = "id") -> DataFrame:
    """For each wanted key the row of least id, if any."""
    first = df.groupBy(*on).agg(F.min(tie).alias(tie))
    return wanted.join(df.join(first, [*on, tie], "left_semi"), on, "left")


def users_by_role(users: DataFrame, roles: Sequence[str] | None = ("recepcionista",)) -> DataFrame:
    """Confirmed users with one of the roles, by creation. None: any role. The listing of staff has always shown receptionists only; ask for more by name."""
    found = users.where("confirmed")
    return (found.where(F.col("rol").isin(*roles)) if roles else found).orderBy(*keys("createdAt"))


def order_search(orders: DataFrame, patients: DataFrame, doctors: DataFrame, items: DataFrame, q: str | None = None, status: str | None = None, low: str | None = None, high: str | None = None, number: int | None = 1, size: int | None = 10, name: str = "firstName") -> DataFrame:
    """A page of active orders, newest first, with patient, doctor and items nested.

    Orders are filtered and paged first, joined with the patient only for its name; doctor and items are joined for
    the page alone. Inactive patients and doctors are shown.
    """
    found = order_matches(orders, patients, q, status, low, high, name)
    chosen = page(found, keys("-createdAt"), number, size)
    nested = items.join(chosen.select(F.col("id").alias("serviceOrderId")), "serviceOrderId", "left_semi")
    nested = nested.groupBy("serviceOrderId").agg(F.sort_array(F.collect_list(F.struct(*[c for c in items.columns if c != "serviceOrderId"]))).alias("items"))
    doctor = doctors.select(F.col("id").alias("doctorId"), F.struct(*doctors.columns).alias("doctor"))
    return chosen.join(doctor, "doctorId", "left").join(nested.withColumnRenamed("serviceOrderId", "id"), "id", "left")


def order_matches(orders: DataFrame, patients: DataFrame, q: str | None = None, status: str | None = None, low: str | None = None, high: str | None = None, name: str = "firstName") -> DataFrame:
    found = active(orders).where(equal_to(status=status)).where(between("createdAt", low, high))
    patient = patients.select(F.col("id").alias("patientId"), F.col(name).alias("patientName"))
    return found.join(patient, "patientId", "left").where(contains(q, ["folio", "patientName"]))


def expanded(parents: DataFrame, children: DataFrame, link: str, to: str, order: Sequence[str], key: str = "id") -> DataFrame:
    """Parents with their children as a sorted array; empty where there are none."""
    fields = [*order, *(c for c in children.columns if c not in {link, *order})]
    grouped = children.groupBy(F.col(link).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(to))
    return parents.join(grouped, key, "left").withColumn(to, F.coalesce(to, F.array().cast(grouped.schema[to].dataType)))


def study_details(details: DataFrame, studies: DataFrame | None) -> DataFrame:
    """Active details in order; of active studies, if studies are given."""
    found = active(details)
    if studies is not None:
        found = found.join(active(studies).select(F.col("id").alias("studyId")), "studyId", "left_semi")
    return found.orderBy(*keys("studyId", "sortOrder"))
