"""Rows above and below marked ones along parent links, by pointer doubling.

Each row holds a pointer that is 2^k parents up after k rounds, so a chain of n rows is settled in about log2(n)
rounds, and a cycle, whose pointers never end, after as many as the table has rows. A round joins the pointers with
each other; marks of the rows below one are combined before the shuffle, so a parent of very many rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.sources.io import discarded, stored


def below(table: DataFrame, marked: DataFrame, key: str = "id", parent: str = "parentId") -> DataFrame:
    """(key): rows that are marked or have a marked row above them."""
    return _closure(table, marked, key, parent, up=False)


def above(table: DataFrame, marked: DataFrame, key: str = "id", parent: str = "parentId") -> DataFrame:
    """(key): rows that are marked or have a marked row below them."""
    return _closure(table, marked, key, parent, up=True)


def _closure(table: DataFrame, marked: DataFrame, key: str, parent: str, up: bool) -> DataFrame:
    """The rows at or below (up: at or above) those marked; marks of rows that the table lacks are nothing.

    After k rounds `hit` tells whether a mark is fewer than 2^k steps away, and `link` is 2^k steps up.
    """
    marks = marked.select(F.col(key).alias("node")).distinct().withColumn("hit", F.lit(True))
    rows = table.select(F.col(key).alias("node"), F.col(parent).alias("link")).where(F.col("node").isNotNull())
    now = rows.join(marks, "node", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    # below: what is hit needs to look no further up
    now = stored(now.withColumn("link", F.when(F.lit(up) | ~F.col("hit"), F.col("link"))), "tree")
    n, steps = now.count(), 1
    while steps < n and now.where("link IS NOT NULL").limit(1).count():
        other = now.select(F.col("node").alias("link"), F.col("link").alias("further"), F.col("hit").alias("seen"))
        if up:
            # a mark in reach of a row is in reach of what its link names
            found = now.where("hit AND link IS NOT NULL").select(F.col("link").alias("node"), F.lit(True).alias("more")).distinct()
            new = now.join(other.drop("seen"), "link", "left").select("node", "hit", F.col("further").alias("link"))
            new = new.join(found, "node", "left").select("node", "link", (F.col("hit") | F.coalesce("more", F.lit(False))).alias("hit"))
        else:
            new = now.join(other, "link", "left").select("node", "further", (F.col("hit") | F.coalesce("seen", F.lit(False))).alias("hit"))
            new = new.select("node", F.when(~F.col("hit"), F.col("further")).alias("link"), "hit")
        was, now = now, stored(new, "tree")
        discarded(was)
        steps *= 2
    return now.where("hit").select(F.col("node").alias(key))
