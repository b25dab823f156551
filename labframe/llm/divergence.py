"""Source divergence audit: how far the sources of a language are from each other, by bitmaps of count levels.

Every (language, source) group gives each kept term of the language, those of at least `least` of its documents, a
smoothed share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)). Two groups are as far apart as their
shares differ, summed over all V terms. A share only depends on the group and the count, and counts repeat: so each
group stores, for each count that it has, the set of terms with that count, as bits. ANDing a level of one group with
a level of another and counting bits gives the number of terms with this pair of counts, which multiplies the
difference of their shares. Counts of zero have no bits: what a level shares with no level of the other group is its
size less the bits that it shares, and what neither group has is the rest of V.

Terms are numbered by falling total count, so the levels of a word of 64 terms are few, and words of zeros are not
stored. A table of bitmaps has a row for each (language, word, source, count). Pairs of groups are added up by ranges
of words: a task gets all rows of a range for two chunks of at most CHUNK sources and returns one number for a pair
of groups. So no task grows with the vocabulary, and none holds more than two chunks of sources.

Terms are counted in batches of Arrow memory: bytes are classed by a table, words are coded, and (group, term) pairs
are added up before they leave the task.

Defined results: null texts have no terms; null languages and sources are ''; repeated rows count each; other columns
are ignored; a group without terms takes part with counts of zero; a language that keeps no term has pairs of value 0
and no terms; a language of one source has no pairs; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.llm.common import broadcast_if_small, by_bytes, discarded, guarded, stored
from labframe.llm.pieces import expanded

#: Documents of a language that a kept term is in; ranks of the terms that are reported; of the shares: scale and what is added to counts.
LEAST, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Terms in a word, words in a range, sources in a chunk, bytes of text that are counted together, pairs of rows that are ANDed at once.
WORD, RANGE, CHUNK, BATCH_BYTES, PAIRS = 64, 128, 64, 6_000_000, 2_000_000
_CLASS = np.zeros(256, np.uint8)
for _b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):  # what a term is of, A-Z lower-cased
    _CLASS[_b] = _b + 32 if _b < 0x5B else _b


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each term, terms) of all texts in turn."""
    raw = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = _CLASS[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    letters = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(letters[starts], letters[-1]).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return np.searchsorted(ends, starts, "right") - 1, terms


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it, in each group of docs (lang, source, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, BATCH_BYTES):
            row, terms = terms_of(batch.column(text))
            coded = terms.dictionary_encode()
            known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            groups = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in ("lang", "source")])
            of, names = groups.factorize()
            width = max(len(known), 1)
            pair, n = np.unique(row * width + code, return_counts=True)
            key, at = np.unique(of[pair // width] * width + pair % width, return_inverse=True)
            sums = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            group, term = key // width, pa.array(key % width)
            columns = [pa.array(names.get_level_values(i).to_numpy(object)[group], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, known.take(term).cast(pa.binary()).cast(pa.string()), *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"])

    rows = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(kept: DataFrame) -> DataFrame:
    """kept (lang, term, total) with the word and bit of each term; a word has terms of one language and of similar counts."""
    rows = kept.repartitionByRange("lang", F.desc("total"), "term").sortWithinPartitions("lang", F.desc("total"), "term").select("lang", "term", "total", F.spark_partition_id().cast("bigint").alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lang = -1, None
        for batch in batches:
            places = []
            for x in batch.column("lang").to_pylist():
                place = place + 1 if x == lang else -(-(place + 1) // WORD) * WORD
                lang = x
                places.append(place)
            at = np.array(places, np.int64)
            word = (batch.column("part").to_numpy() << 40) + at // WORD
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "term", "total")), pa.array(word), pa.array((at % WORD).astype(np.int32))], ["lang", "term", "total", "word", "bit"])

    return rows.mapInArrow(number, "lang string, term string, total bigint, word bigint, bit int")


def share(n: Column | int, total: Column, kept: Column) -> Column:
    """The smoothed share, exactly; 0 where the language keeps no term."""
    whole = lambda c: c.cast("decimal(20,0)")
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    up, down = F.lit(SCALE).cast("decimal(10,0)") * whole(n + SMOOTH), whole(total + SMOOTH * kept)
    return F.when(kept > 0, 1 + F.call_function("div", up, down)).otherwise(0).cast("bigint")


def shares(n: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The same for arrays; counts too large for 64 bits are divided as Python numbers."""
    if len(n) and n.max() > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(a) + SMOOTH) // (int(b) + SMOOTH * int(c)) for a, b, c in zip(n, total, kept, strict=True)], np.int64)
    return 1 + SCALE * (n + SMOOTH) // (total + SMOOTH * kept)


def distances(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) for each pair of sources a < b of a range of words and two chunks.

    rows: (lang, ca, cb, chunk, source, word, n, bits, total, kept), one of them for each source with its sum and V,
    and a word of -1. value is what the range adds to V times the difference of the shares of a count of zero.
    """
    heads = rows[rows.word < 0].drop_duplicates("source").sort_values("source")
    names, kept = heads.source.to_numpy(), int(heads.kept.iloc[0])
    zero = shares(np.zeros(len(names), np.int64), heads.total.to_numpy(), np.full(len(names), kept))
    levels = rows[rows.word >= 0]
    s = np.searchsorted(names, levels.source.to_numpy(object))
    order = np.lexsort((s, levels.word.to_numpy(np.int64)))
    s, word = s[order], levels.word.to_numpy(np.int64)[order]
    bits, n = levels.bits.to_numpy(np.int64)[order].view(np.uint64), levels.n.to_numpy(np.int64)[order]
    p = shares(n, heads.total.to_numpy()[s], np.full(len(s), kept))
    size = np.bitwise_count(bits).astype(np.int64)
    # zeros by complement: every level against the other groups' count of zero ...
    apart = np.abs(zero[:, None] - zero)
    value = np.zeros((len(names), len(names)), np.int64)
    for lo in range(0, len(s), PAIRS // len(names) + 1):
        i = slice(lo, lo + PAIRS // len(names) + 1)
        np.add.at(value, s[i], size[i, None] * (np.abs(p[i, None] - zero) - apart[s[i]]))
    value = value + value.T
    # ... and what two levels share is taken back from both
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    ends = np.repeat(np.append(first[1:], len(word)), np.diff(np.append(first, len(word)))) if len(word) else first
    after = ends - np.arange(len(word)) - 1
    steps = np.append(np.flatnonzero(np.diff(np.cumsum(after) // PAIRS, prepend=-1)), len(word))
    shared = np.zeros(value.size)
    for lo, hi in zip(steps[:-1], steps[1:], strict=True):
        i = np.arange(lo, hi)
        left = np.repeat(i, after[i])
        right = expanded(np.arange(len(i)), i + 1, after[i])
        cell = np.bitwise_count(bits[left] & bits[right]).astype(np.int64)
        some = np.flatnonzero((cell > 0) & (s[left] != s[right]))
        cell, left, right = cell[some], left[some], right[some]
        a, b = s[left], s[right]
        f = np.abs(p[left] - p[right]) - np.abs(p[left] - zero[b]) - np.abs(p[right] - zero[a]) + apart[a, b]
        shared += np.bincount(a * len(names) + b, cell * f, value.size)  # below 2^53, so exact
    shared = shared.astype(np.int64).reshape(value.shape)
    value += shared + shared.T
    a, b = np.triu_indices(len(names), 1)
    ca, cb = rows.ca.iloc[0], rows.cb.iloc[0]
    if ca != cb:  # pairs inside a chunk belong to another task
        chunk = heads.chunk.to_numpy()
        a, b = (x[chunk[a] != chunk[b]] for x in (a, b))
    return pd.DataFrame({"lang": rows.lang.iloc[0], "a": names[a], "b": names[b], "value": value[a, b]})


def bitmaps(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, word, source, n, bits): the count levels of each group, words of zeros left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return counts.join(terms.drop("total"), ["lang", "term"]).groupBy("lang", "word", "source", "n").agg(F.bit_or(bit).alias("bits"))


def pair_sums(levels: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, a, b, value) for the pairs a < b of groups (lang, source, total, kept, sources) of one language that some range of words has."""
    chunks = F.ceil(F.col("sources") / chunk).cast("int")
    of = groups.withColumn("chunk", F.pmod(F.xxhash64("source"), chunks).cast("int"))
    span = F.shiftright("word", 40), F.floor((F.col("word") % (1 << 40)) / RANGE)
    rows = levels.withColumns({"part": span[0], "range": span[1]})
    heads = rows.select("lang", "part", "range").distinct().join(of, "lang").select("lang", "part", "range", "source", "chunk", "total", "kept", chunks.alias("chunks"))
    absent = lambda *names: {c: F.lit(0).cast("bigint") for c in names}  # noqa: E731  (nulls would make floats of 64-bit sets)
    heads = heads.withColumns({"word": F.lit(-1).cast("bigint"), **absent("n", "bits")})
    rows = rows.join(broadcast_if_small(of.select("lang", "source", "chunk", chunks.alias("chunks"))), ["lang", "source"]).withColumns(absent("total", "kept"))
    both = rows.unionByName(heads)
    # a source goes to the tasks of its chunk with every other chunk
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    both = both.select("*", other).withColumns({"ca": F.least("chunk", "other"), "cb": F.greatest("chunk", "other")})
    found = both.groupBy("lang", "part", "range", "ca", "cb").applyInPandas(distances, "lang string, a string, b string, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group: the other sources of its language by distance, and the terms it has more of than its language."""
    guarded(df.columns, [text, lang, source], "divergence")
    docs = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "first": F.min("source").over(term)})
    counts = stored(counts.where(F.col("docs") >= least).select("lang", "source", "term", "n", "total", (F.col("first") == F.col("source")).alias("first")), "counts")
    terms = stored(numbered(counts.where("first").select("lang", "term", "total")), "terms")
    levels = stored(bitmaps(counts, terms), "levels")

    whole = docs.select("lang", "source").distinct()
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    sums = levels.groupBy("lang", "source").agg(F.sum(F.col("n") * F.bit_count("bits")).alias("total"))
    groups = whole.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(whole.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    groups = stored(groups.select("lang", "source", "sources", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total"))), "groups")

    zero = groups.select("lang", "kept", "source", share(0, F.col("total"), F.col("kept")).alias("zero"))
    pairs = zero.join(zero.select("lang", F.col("source").alias("item"), F.col("zero").alias("other")), "lang").where("source <> item")
    added = stored(pair_sums(levels, groups, chunk), "pair_sums")
    pairs = pairs.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(added, ["lang", "a", "b"], "left")
    by = lambda *c: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    value = F.col("kept") * F.abs(F.col("zero") - F.col("other")) + F.coalesce("value", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value")).withColumn("rank", F.row_number().over(by()))

    held = counts.withColumnRenamed("total", "term_total").join(broadcast_if_small(groups.select("lang", "source", "total", "kept", "lang_total")), ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("term_total"), F.col("lang_total"), F.col("kept"))
    found = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    found = found.withColumn("rank", F.row_number().over(by())).where(F.col("rank") <= top)
    out = stored(pairs.unionByName(found), "divergence")
    discarded(counts, terms, levels, groups, added)
    return out
