"""Pricing of orders: tiers, line discounts, courtesy. Arithmetic is in doubles, rounded once when stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.functions.text import iso_time, money
from labframe.operators.lookup import reference_faults, study_cardinality

#: Price types and the columns of a study that hold them; any other type has the normal price.
TIERS = {"dif": "difPrice", "special": "specialPrice", "hospital": "hospitalPrice", "other": "otherPrice"}


def unit_price(price_type: Column) -> Column:
    out = F.col("normalPrice").cast("double")
    for name, column in TIERS.items():
        out = F.when(price_type == name, F.col(column).cast("double")).otherwise(out)
    return out


def line_amount(unit: Column, quantity: Column, discount: Column) -> Column:
    """unit * quantity * (1 - discount / 100), in this order; above 100 per cent it is negative."""
    return unit * quantity * (F.lit(1.0) - F.coalesce(discount.cast("double"), F.lit(0.0)) / F.lit(100.0))


def courtesy(subtotal: Column, percent: Column) -> Column:
    """subtotal * (percent / 100), in this order: 5 per cent of 0.70 are 0.034999..., so 0.03 when stored."""
    return subtotal * (percent / F.lit(100.0))


def priced_lines(items: DataFrame, studies: DataFrame) -> DataFrame:
    """Items of known studies with the study's name and price as they are now, and the unrounded line."""
    prices = studies.select(F.col("id").alias("studyId"), F.col("name").alias("studyNameSnapshot"), "normalPrice", *TIERS.values())
    out = items.join(prices, "studyId").withColumn("unitPrice", unit_price(F.col("priceType")))
    return out.withColumn("line", line_amount(F.col("unitPrice"), F.col("quantity"), F.col("discountPercent"))).withColumn("subtotalAmount", money(F.col("line"))).drop("normalPrice", *TIERS.values())


def order_amounts(lines: DataFrame, orders: DataFrame, order: list[str], key: str = "serviceOrderId") -> DataFrame:
    """(id, subtotalAmount, discountAmount, totalAmount, fits): unrounded lines added in input order, then courtesy.

    The additions follow the order of the lines, so the doubles are the same however the rows were partitioned. The
    stored subtotal can differ from the sum of the stored lines. Amounts that do not fit are null, and `fits` false.
    """
    rows = lines.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("lines"))
    subtotal = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["line"])
    out = rows.select("id", subtotal.alias("s")).join(orders.select("id", F.coalesce(F.col("courtesyPercent").cast("double"), F.lit(0.0)).alias("c")), "id")
    discount = courtesy(F.col("s"), F.col("c"))
    amounts = {"subtotalAmount": money(F.col("s")), "discountAmount": money(discount), "totalAmount": money(F.col("s") - discount)}
    out = out.withColumns(amounts)
    return out.select("id", *amounts, (F.col("subtotalAmount").isNotNull() & F.col("discountAmount").isNotNull() & F.col("totalAmount").isNotNull()).alias("fits"))


def headers(batch: DataFrame) -> DataFrame:
    """New order headers with the defaults of a create: status pending, no courtesy, sampleAt and deliveryAt read from text if given."""
    times = {c: iso_time(F.col(c)) for c in ("sampleAt", "deliveryAt")}
    return batch.withColumns(times | {"status": F.coalesce("status", F.lit("pending")), "courtesyPercent": F.coalesce(F.col("courtesyPercent").cast("double"), F.lit(0.0))})


def created(batch: DataFrame, items: DataFrame, patients: DataFrame, doctors: DataFrame, studies: DataFrame, order: list[str]) -> DataFrame:
    """New orders (headers of `batch`, their items apart) with amounts and the first fault or null.

    Faults: PATIENT, DOCTOR, NO_ITEMS, STUDY (a study is unknown or listed twice), AMOUNT (it does not fit its column).
    """
    head = reference_faults(headers(batch), patients, doctors, items).withColumnRenamed("fault", "refused")
    counted = study_cardinality(items, studies).select(F.col("serviceOrderId").alias("id"), F.col("ok").alias("studies"))
    amounts = order_amounts(priced_lines(items, studies), head, order)
    out = head.join(counted, "id", "left").join(amounts, "id", "left")
    fault = F.coalesce("refused", F.when(~F.col("studies"), "STUDY").when(~F.col("fits"), "AMOUNT"))
    return out.withColumn("fault", fault).drop("refused", "studies", "fits")


def with_courtesy(orders: DataFrame, patches: DataFrame) -> DataFrame:
    """Orders whose courtesy a patch (id, courtesyPercent) changes get discount and total anew, from the stored subtotal.

    Of several patches of an order the last by batch_seq counts; without that column the job fails on them.
    """
    from labframe.operators.mutate import merged

    new = merged(patches.drop("fields"), ["courtesyPercent"]).select("id", F.col("courtesyPercent").cast("double").alias("new"))
    subtotal = F.col("subtotalAmount").cast("double")
    discount = courtesy(subtotal, F.col("new"))
    changed = F.col("new").isNotNull()
    out = orders.join(new, "id", "left").withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in {"courtesyPercent": money(F.col("new"), 5), "discountAmount": money(discount), "totalAmount": money(subtotal - discount)}.items()})
    return out.drop("new")
