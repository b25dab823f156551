"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds the postings (row, position, term) of the training tokens in a table of the shared folder, plus one row
a document that closes it and so tells its length. Terms are known by 64-bit hashes. An index of all tokens serves any
test items; if only some are at hand, the tokens of their terms are enough. From the index come the counts of the test terms. In each window of a test item the two rarest terms are
taken; their posting lists, moved by the terms' offsets in the item, are intersected, which leaves alignments
(document, item, shift) that are almost all true. The words of an alignment are then compared one by one with the
index, and runs of matching words as long as a window are occurrences: an exact phrase match. Proximity matches are
the pairs of lists intersected within a slop instead of exactly; there a window may have terms that no document has.

The test side is broadcast only if it was counted and is small; beyond that Spark joins by term, and adaptive
execution splits a frequent term. Nothing is gathered by document but its own hits.

Defined results: null and empty texts have no words and no hits; items without words are not searched for; a repeated
row of documents gets its own result, a repeated item counts once; null keys are kept (an item's as "null"); columns
other than keys and texts are not looked at; an empty table of documents gives an empty one, empty items give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.llm.common import BROADCAST_ROWS, ascii_lower, guarded, stored

#: Words in a window.
WINDOW = 10
#: Fixed value: what separates words, after A-Z have been lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAKS), lambda w: w != "")


def test_words(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, at, term, word): every word of every item; repeated items once."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    rows = rows.withColumn("item_key", F.xxhash64("item", "words"))
    return rows.select("item", "item_key", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")).withColumn("term", F.xxhash64("word"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (row, at, term, key) of all tokens; term 0 closes a document at its length and has its key.

    With a vocabulary (term) only those tokens are listed, which answers test items of these terms; without one the
    index serves any.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("key"), words(F.col(text)).alias("words"))
    tokens = rows.select("row", "key", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "word"))
    tokens = tokens.select("row", "at", F.when(F.col("word") == "", F.lit(0)).otherwise(F.xxhash64("word")).alias("term"), F.when(F.col("word") == "", F.col("key")).alias("key"))
    if vocabulary is not None:
        end = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("term"))
        tokens = tokens.join(bounded(vocabulary.select("term").unionByName(end), vocabulary.count()), "term", "left_semi")
    return stored(tokens, "postings")


def anchors(test: DataFrame, counts: DataFrame, window: int = WINDOW, exact: bool = True) -> DataFrame:
    """(item_key, pair, k, at, term): for every window of an item its two rarest terms, k being 1 and 2; ties go by the words.

    exact: windows with a term that no document has are left out, as they cannot occur, and a window of one term has it
    twice. Otherwise such terms are, and windows with less than two others.
    """
    w = test.select("item_key", "length", "at", "term", "word").join(counts, "term", "left")
    span = F.sequence(F.greatest(F.lit(0), F.col("at") - (window - 1)), F.greatest(F.lit(0), F.least("at", F.col("length") - window)))
    inside = w.select("item_key", "at", "term", "word", "n", F.explode(span).alias("start"))
    by = Window.partitionBy("item_key", "start")
    first = inside.withColumn("missing", F.max(F.col("n").isNull()).over(by)).where(~F.col("missing")) if exact else inside.where("n IS NOT NULL")
    rarest = first.groupBy("item_key", "start").agg(F.min(F.struct("n", "word", "at", "term")).alias("a"), F.collect_list(F.struct("n", "word", "at", "term")).alias("all"))
    second = F.array_min(F.filter("all", lambda x: x["word"] != F.col("a.word")))
    pairs = rarest.select("item_key", "a", (F.coalesce(second, F.col("a")) if exact else second).alias("b")).where("b IS NOT NULL")
    pairs = pairs.select("item_key", F.col("a.at").alias("a_at"), F.col("a.term").alias("a_term"), F.col("b.at").alias("b_at"), F.col("b.term").alias("b_term")).distinct()
    pairs = pairs.withColumn("pair", F.xxhash64("item_key", "a_at", "b_at"))
    return pairs.select("item_key", "pair", F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("a_at").alias("at"), F.col("a_term").alias("term")), F.struct(F.lit(2).alias("k"), F.col("b_at").alias("at"), F.col("b_term").alias("term")))))


def moved(index: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(k, row, item_key, pair, shift): the posting lists of the anchors, moved so that an occurrence of the item's window has one shift."""
    ends = ends.select("item_key", "pair", "k", F.col("at").alias("item_at"), "term")
    return index.select("row", "at", "term").join(bounded(ends, n), "term").select("k", "row", "item_key", "pair", (F.col("at") - F.col("item_at")).alias("shift"))


def alignments(index: DataFrame, ends: DataFrame) -> DataFrame:
    """(row, item_key, shift) where the lists of both terms of some pair meet exactly."""
    lists = moved(index, ends, ends.count())
    met = lists.groupBy("row", "item_key", "pair", "shift").agg(F.bit_or(F.col("k")).alias("k"))
    return met.where("k = 3").select("row", "item_key", "shift").distinct()


def proximity(index: DataFrame, ends: DataFrame, slop: int = 5) -> DataFrame:
    """(row, item_key) where both terms of some pair stand at most `slop` words from their places in the item relative to each other."""
    lists = moved(index, ends, ends.count()).distinct()
    lists = lists.withColumn("cell", F.floor(F.col("shift") / (slop + 1)).cast("int"))
    a = lists.where("k = 1").select("row", "item_key", "pair", F.col("shift").alias("a"), "cell")
    b = lists.where("k = 2").select("row", "item_key", "pair", F.col("shift").alias("b"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return a.join(b, ["row", "item_key", "pair", "cell"]).where(F.abs(F.col("a") - F.col("b")) <= slop).select("row", "item_key").distinct()


def matched(index: DataFrame, test: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item, at): positions of documents inside occurrences of an item's windows."""
    found = stored(found, "alignments")
    n_test, n_rows = test.count(), found.select("row").distinct().count()
    wanted = found.join(bounded(test.select("item_key", "item", "length", F.col("at").alias("item_at"), "term"), n_test), "item_key").withColumn("at", F.col("item_at") + F.col("shift"))
    near = index.where("term <> 0").select("row", "at", "term").join(bounded(found.select("row").distinct(), n_rows), "row", "left_semi")
    same = wanted.join(near, ["row", "at", "term"]).distinct()
    run = Window.partitionBy("row", "item", "item_key", "shift")
    same = same.withColumn("island", F.col("item_at") - F.row_number().over(run.orderBy("item_at")))
    same = same.withColumn("run", F.count("*").over(Window.partitionBy("row", "item", "item_key", "shift", "island")))
    return same.where(F.col("run") >= F.least(F.lit(window), F.col("length"))).select("row", "item", "at")


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int | None = None, window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs, and n_near (items with proximity matches) if a slop is given.

    index: postings of docs made before; without it the tokens of the items' terms are listed here.
    """
    guarded(docs.columns, [id_column, text], "decontamination")
    guarded(items.columns, [item_id, item_text], "decontamination")
    test = stored(test_words(items, item_id, item_text), "test")
    if index is None:
        index = postings(docs, test.select("term").distinct(), id_column, text)
    counts = index.where("term <> 0").groupBy("term").agg(F.count("*").alias("n"))
    counts = stored(counts.join(test.select("term").distinct(), "term", "left_semi"), "counts")
    ends = stored(anchors(test, counts, window), "anchors")
    hits = stored(matched(index, test, alignments(index, ends), window), "hits")
    places = hits.groupBy("row", "at").agg(F.lit(1).alias("one")).groupBy("row").agg(F.count("*").alias("n_hit"))
    names = hits.groupBy("row", "item").agg(F.lit(1).alias("one")).groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = index.where("term = 0").select("row", F.col("key").alias(id_column), F.col("at").cast("bigint").alias("n_words"))
    out = out.join(places.join(names, "row"), "row", "left")
    extra = []
    if slop is not None:
        near = proximity(index, stored(anchors(test, counts, window, exact=False), "anchors"), slop)
        out = out.join(near.groupBy("row").agg(F.count_distinct("item_key").alias("n_near")), "row", "left")
        extra = [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")]
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(id_column, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *extra)
