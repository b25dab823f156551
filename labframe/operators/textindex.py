"""Contains-search over many terms by a positional index of trigrams, with LIKE as the last word.

The index has a row for each trigram of each indexed value: (gram, id, field, pos). A term is cut at its % signs;
what remains, without places of _, gives trigrams at known distances. Of each term the two rarest are taken: rows
that have both, at the right distance if no % is between them, are candidates, and only these are looked at with LIKE.
The second gram is asked for by (gram, id, field), so a gram that nearly all values have is no hot key.

A term without three plain characters in a row has no trigram; such terms are compared with all rows, as any scan does.
An index is a table of its own: store it once, add the rows of a batch, and search it as often as wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.sources.io import stored

#: Characters of a gram, and grams of a term that are asked for.
GRAM, ASKED = 3, 2


def _grams(text: Column) -> Column:
    """(pos, gram) of a text, from 0."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(0), F.length(text) - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substr(text, i + 1, F.lit(GRAM)).alias("gram")))


def text_index(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(gram, id, field, pos) of every trigram of the columns; null values have none."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("v")
    rows = df.select(F.col(key).alias("id"), values).where("v.value IS NOT NULL")
    return rows.select("id", F.col("v.field").alias("field"), F.inline(_grams(F.col("v.value")))).select("gram", "id", "field", "pos")


def term_grams(terms: DataFrame) -> DataFrame:
    """(term_id, segment, pos, gram) of terms (term_id, q): grams without wildcards, by the stretch between two % signs."""
    cut = terms.select("term_id", F.posexplode(F.split("q", "%")).alias("segment", "text"))
    return cut.select("term_id", "segment", F.inline(_grams(F.col("text")))).where(~F.contains("gram", F.lit("_"))).distinct()


def like(column: Column, q: Column) -> Column:
    """The column contains q, in which % and _ are wildcards and a backslash is itself."""
    return F.like(column, F.concat(F.lit("%"), F.replace(q, F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def _candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(term_id, id, field) that have the two rarest grams of a term at the right distance."""
    found = stored(index.join(asked.select("gram").distinct(), "gram", "left_semi"), "postings")
    sizes = found.groupBy("gram").count()
    rarest = Window.partitionBy("term_id").orderBy(F.coalesce("count", F.lit(0)), "segment", "pos")
    ranked = stored(asked.join(sizes, "gram", "left").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= ASKED), "asked")
    first = ranked.where("rank = 1").select("term_id", "segment", F.col("pos").alias("at"), "gram")
    second = ranked.where("rank = 2").select("term_id", F.col("segment").alias("segment_2"), F.col("pos").alias("at_2"), F.col("gram").alias("gram_2"))
    hits = found.join(first, "gram").select("term_id", "id", "field", "segment", (F.col("pos") - F.col("at")).alias("start")).join(second, "term_id", "left")
    alone = hits.where("gram_2 IS NULL").select("term_id", "id", "field")
    # both sides grow with the table, but lie compressed, so their files look small enough to be sent to the driver
    other = found.select(F.col("gram").alias("gram_2"), "id", "field", F.col("pos").alias("pos_2")).hint("merge")
    both = hits.where("gram_2 IS NOT NULL").join(other, ["gram_2", "id", "field"]).where((F.col("segment") != F.col("segment_2")) | (F.col("start") == F.col("pos_2") - F.col("at_2")))
    return alone.unionByName(both.select("term_id", "id", "field")).distinct()


def matches(df: DataFrame, index: DataFrame, terms: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(term_id, id) of the rows of df that contain a term in some column, by an index that has all of them (and maybe others)."""
    asked = stored(term_grams(terms), "term_grams")
    within = _candidates(asked, index.where(F.col("field").isin(*columns))).join(terms, "term_id")
    rows = df.select(F.col(key).alias("id"), *(F.col(c).alias(f"value of {c}") for c in columns))
    value = reduce(lambda out, c: F.when(F.col("field") == c, F.col(f"value of {c}")).otherwise(out), columns, F.lit(None).cast("string"))
    found = within.join(rows.hint("merge"), "id").where(like(value, F.col("q"))).select("term_id", "id")
    plain = terms.join(asked, "term_id", "left_anti")
    if plain.limit(1).count():  # no gram to ask for
        hit = reduce(lambda a, b: a | b, [F.coalesce(like(F.col(f"value of {c}"), F.col("q")), F.lit(False)) for c in columns])
        found = found.unionByName(rows.join(plain, hit).select("term_id", "id"))
    return found.distinct()
