"""Result sheets: drafts from the catalogue, values that snapshot a detail, creation with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.operators.lookup import flagged
from labframe.operators.mutate import SEQUENCE, patched, replaced_children
from labframe.operators.search import active
from labframe.sources.io import stored


#: Rows from which a table is never sent to the driver to be broadcast: stored ones look smaller than they are.
MANY_ROWS = 500_000


def _met(df: DataFrame, many: bool) -> DataFrame:
    """df as a side of a join: merged if it has many rows, else as Spark chooses."""
    return df.hint("merge") if many else df


def drafts(items: DataFrame, orders: DataFrame, results: DataFrame, details: DataFrame) -> DataFrame:
    """A draft for each item of an active order without an active result: its values, one for each active detail of the study in order.

    Categories come along; a study without details gives a draft without values.
    """
    free = items.join(active(results).select(F.col("serviceOrderItemId").alias("id")), "id", "left_anti")
    free = free.join(active(orders).select(F.col("id").alias("serviceOrderId"), "sampleAt"), "serviceOrderId")
    rows = active(details).groupBy("studyId").agg(F.sort_array(F.collect_list(F.struct("sortOrder", F.col("id").alias("studyDetailId"), F.col("name").alias("label"), "unit", "referenceValue", F.lit(True).alias("visible")))).alias("values"))
    out = free.join(rows, "studyId", "left").withColumn("values", F.coalesce("values", F.array().cast(rows.schema["values"].dataType)))
    return out.select(F.col("id").alias("serviceOrderItemId"), "serviceOrderId", "sampleAt", F.lit(True).alias("isDraft"), F.lit(True).alias("isActive"), "values")


def snapshot(values: DataFrame, details: DataFrame) -> DataFrame:
    """Submitted values with a found detail's label, unit and reference in place of their own, also where the detail has none."""
    # values without a detail have only null for a key, which would bring them all into one task; they go by all they hold
    by = F.when(F.col("studyDetailId").isNull(), F.xxhash64(*values.columns)).otherwise(F.col("studyDetailId"))
    known = details.select(F.col("id").alias("studyDetailId"), F.col("id").alias("by_"), F.lit(True).alias("known"), *(F.col(c).alias(f"d_{c}") for c in ("name", "unit", "referenceValue")))
    out = values.withColumn("by_", by).join(_met(known, details.count() > MANY_ROWS), ["studyDetailId", "by_"], "left")
    for to, of in {"label": "name", "unit": "unit", "referenceValue": "referenceValue"}.items():
        out = out.withColumn(to, F.when(F.col("known"), F.col(f"d_{of}")).otherwise(F.col(to)))
    return out.drop("by_", "known", "d_name", "d_unit", "d_referenceValue")


def created(batch: DataFrame, orders: DataFrame, items: DataFrame, results: DataFrame, sequence: str = "batch_seq") -> DataFrame:
    """New result headers with defaults and the first fault or null: ORDER, ITEM (not of that order), EXISTS (an active result has the item), REPEATED."""
    out = batch.join(active(orders).select(F.col("id").alias("serviceOrderId"), F.col("sampleAt").alias("orderSampleAt"), F.lit(True).alias("o")), "serviceOrderId", "left")
    out = out.join(items.select(F.col("id").alias("serviceOrderItemId"), "serviceOrderId", F.lit(True).alias("i")).distinct(), ["serviceOrderItemId", "serviceOrderId"], "left")
    out = flagged(out, active(results), "serviceOrderItemId", "r", "serviceOrderItemId")
    good = F.col("o") & F.col("i") & ~F.col("r")
    first = out.where(good).groupBy("serviceOrderItemId").agg(F.min(sequence).alias("first"))
    out = out.join(first, "serviceOrderItemId", "left")
    fault = F.when(F.col("o").isNull(), "ORDER").when(F.col("i").isNull(), "ITEM").when(F.col("r"), "EXISTS").when(F.col(sequence) > F.col("first"), "REPEATED")
    out = out.withColumns({"fault": fault, "sampleAt": F.coalesce("sampleAt", "orderSampleAt"), "isDraft": F.coalesce("isDraft", F.lit(True))})
    return out.drop("o", "i", "r", "first", "orderSampleAt")


def results_patched(results: DataFrame, values: DataFrame, patches: DataFrame, new_values: DataFrame, details: DataFrame, sequence: str = SEQUENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, values, patches with the first fault or null) after patches (id, fields, columns) with new values apart.

    Faults: MISSING (no active result), ORDER, ITEM (the result's order or item differs; they never change). Times are
    set if given; method, observations and isDraft also to null if the patch names them. A result that brings values
    (studyResultId, ...) loses its old ones, and the new ones snapshot their details; without any it keeps them.
    Several patches of a result take effect in the order of `sequence`; values then name their patch by it, and those of
    the last good patch that brings any stay.
    """
    old = results.select("id", F.col("isActive").alias("there"), F.col("serviceOrderId").alias("o"), F.col("serviceOrderItemId").alias("i"))
    other = lambda c, was: F.coalesce(F.col(c) != F.col(was), F.lit(False))
    fault = F.when(~F.coalesce("there", F.lit(False)), "MISSING").when(other("serviceOrderId", "o"), "ORDER").when(other("serviceOrderItemId", "i"), "ITEM")
    # stored, as each of the three tables reads the patches and two of them the new values
    state = stored(patches.join(old.hint("merge"), "id", "left").withColumn("fault", fault).select(*patches.columns, "fault"), "patches")
    good, many = state.where("fault IS NULL"), state.count() > MANY_ROWS
    out = patched(results, good, ["sampleAt", "reportedAt", "method", "observations", "isDraft"], ["method", "observations", "isDraft"], sequence=sequence, many=many)
    by = [sequence] if sequence in patches.columns and sequence in new_values.columns else []
    mine = new_values.join(_met(good.select(F.col("id").alias("studyResultId"), *by), many), ["studyResultId", *by], "left_semi")
    if by:
        mine = stored(mine, "good_values")
        last = mine.groupBy("studyResultId").agg(F.max(sequence).alias(sequence))
        mine = mine.join(_met(last, many), ["studyResultId", sequence], "left_semi")
    new = stored(snapshot(mine, details).select(*values.columns), "new_values")
    return out, replaced_children(values, new, "studyResultId", many), state
