"""Bulk validation: named rules over columns, nested ones over arrays, all faults of a row with their paths.

A rule is a function from a column to a condition; a null is only a fault of `required`. Values come as text (see
sources.io.as_text) or typed. Nothing here runs Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.functions.text import ISO
from labframe.sources.io import appended
from labframe.sources.schema import TableSpec

FAULT = "struct<field:string,message:string>"


@dataclass(frozen=True)
class Rule:
    field: str
    message: str
    holds: Callable[[Column], Column]
    required: bool = False

    def partial(self) -> Rule:
        return replace(self, required=False)


@dataclass(frozen=True)
class Each:
    """Rules for every element of an array of records."""

    field: str
    rules: tuple[Rule, ...]
    least: int = 0

    def partial(self) -> Each:
        return replace(self, least=0)


def required(field: str) -> Rule:
    return Rule(field, "is required", lambda c: c.isNotNull() & (c.cast("string") != ""), True)


def text(field: str, least: int = 0, most: int | None = None) -> Rule:
    return Rule(field, f"must have {least} to {most} characters" if most else f"must have {least} characters or more", lambda c: (F.length(c) >= least) & (F.length(c) <= most if most else F.lit(True)))


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(field, f"must be one of {', '.join(values)}", lambda c: c.isin(*values))


def iso_date(field: str) -> Rule:
    return Rule(field, "must be an ISO date", lambda c: c.rlike(ISO) & F.try_to_timestamp(c).isNotNull())


def matching(field: str, pattern: str, message: str = "has a wrong format") -> Rule:
    """The pattern has to end with \\z: a dollar sign lets a last line break pass."""
    return Rule(field, message, lambda c: c.rlike(pattern))


def email(field: str) -> Rule:
    return matching(field, r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\z", "must be an e-mail address")


def no_brackets(field: str) -> Rule:
    return matching(field, r"^[^<>]*\z", "must not contain angle brackets")


def code6(field: str) -> Rule:
    return matching(field, r"^[0-9]{6}\z", "must have six digits")


def identifier(field: str) -> Rule:
    return matching(field, r"^-?[0-9]+\z", "must be a whole number")


def integer(field: str) -> Rule:
    return Rule(field, "must be an integer", lambda c: F.coalesce(c.try_cast("double") == F.floor(c.try_cast("double")), F.lit(False)))


def number(field: str, least: float | None = None, most: float | None = None) -> Rule:
    def holds(c: Column) -> Column:
        n = c.try_cast("double")
        return n.isNotNull() & (n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True))

    return Rule(field, "must be a number" + (f" of at least {least}" if least is not None else "") + (f" of at most {most}" if most is not None else ""), holds)


def boolean(field: str) -> Rule:
    """A real boolean: unlike a plain truth test, "false" is false."""
    return Rule(field, "must be a boolean", lambda c: c.cast("string").try_cast("boolean").isNotNull())


def fault(rule: Rule, value: Column, path: Column) -> Column:
    broken = ~F.coalesce(rule.holds(value), F.lit(False)) if rule.required else value.isNotNull() & ~F.coalesce(rule.holds(value), F.lit(False))
    return F.when(broken, F.struct(path.alias("field"), F.lit(rule.message).alias("message")))


def found(rules: Sequence[Rule | Each], record: Callable[[str], Column] = F.col) -> Column:
    flat = [fault(r, record(r.field), F.lit(r.field)) for r in rules if isinstance(r, Rule)]
    parts = [F.array(*flat) if flat else F.array().cast(f"array<{FAULT}>")]
    for e in (r for r in rules if isinstance(r, Each)):
        items = record(e.field)
        if e.least:
            parts.append(F.array(F.when(F.coalesce(F.size(items), F.lit(0)) < e.least, F.struct(F.lit(e.field).alias("field"), F.lit(f"must have {e.least} elements or more").alias("message")))))

        def one(x: Column, i: Column, e: Each = e) -> Column:
            return F.array(*(fault(r, x[r.field], F.concat_ws(".", F.lit(e.field), i.cast("string"), F.lit(r.field))) for r in e.rules))

        parts.append(F.coalesce(F.flatten(F.transform(items, lambda x, i: one(x, i))), F.array().cast(f"array<{FAULT}>")))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def validated(df: DataFrame, rules: Sequence[Rule | Each]) -> DataFrame:
    """df with `errors`: every broken rule's field path and message."""
    return df.withColumn("errors", found(rules))


def partial(rules: Sequence[Rule | Each]) -> list[Rule | Each]:
    """The rules of a patch: whatever is given must hold, nothing is required."""
    return [r.partial() if isinstance(r, Each) else r.partial() for r in rules]


def storage_rules(spec: TableSpec) -> list[Rule]:
    """What the table itself demands: lengths, enumerations, required columns, decimals that fit."""
    decimals = [f for f in spec.struct.fields if f.dataType.typeName() == "decimal"]
    fits = [Rule(f.name, "does not fit its column", lambda c, kind=f.dataType.simpleString(): c.try_cast("double").try_cast(kind).isNotNull()) for f in decimals]
    return [*(required(c) for c in spec.required), *(text(c, 0, n) for c, n in spec.lengths.items()), *(one_of(c, v) for c, v in spec.enums.items()), *fits]


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their errors)."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def routed(df: DataFrame, folder: str, batch: str) -> None:
    """Appends a batch's accepted rows to `folder`/accepted and the rejected ones, with their errors, to `folder`/rejected."""
    good, bad = split(df)
    appended(good, f"{folder}/accepted", batch)
    appended(bad, f"{folder}/rejected", batch)
