"""Substring dedup: near copies of paragraphs by MinHash banding, and every exactly repeated passage at any place.

Paragraphs are the lines of a text with at least MIN_WORDS words; runs of shorter lines, up to the next such line or
blank line, are one paragraph if they have that many words together. `tuned` picks the number of bands for the wanted
recall; paragraphs of unlike texts share almost no shingles of five words, so short bands bring few false meetings.
Equal paragraphs are one class before banding, colliding classes are joined, and links are verified by the exact
Jaccard similarity of their shingle sets (see near_dup.py, whose buckets are compared whole without emitting all
pairs). In each component the first paragraph, by key and place, stays; the others are removed.

Paragraphs of fewer words are classed by their words alone and counted, but stay.

Passages are runs of at least MIN_WORDS words, over the ends of lines and inside longer lines. Of equal windows of
that many words the first, by key and place, stays and the words of the others go. Windows are not compared one by
one: equal windows have the same least hash of half as many words (winnowing), so a text falls into stretches of some
dozen windows with one such anchor, whose words have a 128-bit digest. Stretches whose anchor is found once, and once
in them, are done with; of stretches with equal digests all but the first go; and single windows are hashed only in the first of
each kind of stretch, where kinds share an anchor or one repeats it. Both only meet by a sum for each digest, so a passage with many
copies makes no pairs.

Defined results: null and empty texts have no paragraphs or passages; repeated rows of one key and text count as one
document's (the first stays in all of them), rows of one key with different texts are different documents; null keys
come first and are documents like others; columns other than key and text are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labframe.llm.common import broadcast_if_small, by_bytes, discarded, guarded, stored
from labframe.llm.near_dup import BATCH_BYTES, SHINGLE, SIMILARITY, Scheme, clustered, document, mixed, node_of, signed, words_of

#: Fewest words of a paragraph or passage that is compared.
MIN_WORDS = 50
#: Bytes of text in a batch.
PASSAGE_BYTES = 1_000_000
#: Odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tuned(similarity: float, miss: float = 3e-4, rows: int = 3) -> Scheme:
    """Enough bands of `rows` minhashes that sets of this similarity miss each other with a probability of at most `miss`."""
    return Scheme(math.ceil(math.log(miss) / math.log(1 - similarity**rows)), rows)


#: A paragraph's place is first * LINES + last, of its line numbers.
LINES = 1 << 31


def paragraphs(min_words: int, shorter: bool = False):
    """A unit function: lines with enough words, and runs of shorter ones between them and blank lines if they have enough together.

    shorter: the runs that have some words, but not enough, instead.
    """

    def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        lines = pc.split_pattern(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), "\n")
        offsets = lines.offsets.to_numpy().astype(np.int64)
        n = np.diff(offsets)
        row, line = within(n)
        flat = lines.flatten()
        bare = pc.ascii_trim_whitespace(flat)
        words = np.where(pc.binary_length(bare).to_numpy() > 0, pc.list_value_length(pc.ascii_split_whitespace(bare)).to_numpy(), 0)
        # a run goes on where a short line follows a short line of its text
        short = (words > 0) & (words < min_words)
        first = np.ones(len(row), bool)
        first[1:] = ~(short[1:] & short[:-1] & (row[1:] == row[:-1]))
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(row))
        total = np.add.reduceat(words, starts) if len(row) else starts
        keep = np.flatnonzero((total > 0) & (total < min_words) if shorter else total >= min_words)
        starts, ends = starts[keep], ends[keep]
        run, step = within(ends - starts)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, ends - starts)), pa.int32()), flat.take(pa.array(starts[run] + step)).cast(pa.string())), "\n")
        return row[starts], line[starts] * LINES + line[ends - 1], texts

    return units


def rolled(words: np.ndarray, base: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from low up to high, for each pair of places."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(words), base, np.uint64))
        down = np.cumprod(np.full(len(words), pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
        return mixed((sums[high] - sums[low]) * down[low])


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of each `width` neighbouring words."""
    low = np.arange(max(0, len(words) - width + 1))
    return rolled(words, base, low, low + width) if len(low) else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    held = 1
    while 2 * held <= width:
        x, held = np.minimum(x[:-held], x[held:]), 2 * held
    return np.minimum(x[: len(x) - (width - held)], x[width - held :])


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of each element of groups of these sizes."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def of_documents(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts that have a row in `found`, with its arrays; only the documents' digests are broadcast, if they are few."""
    return texts.join(broadcast_if_small(found.select("doc")), "doc", "left_semi").join(found, "doc")


def stretches(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, doc, anchor, low, high, loops, wa, wb) of texts (id, doc, text): neighbouring windows, from word low up to word high, with the same least hash.

    anchor is that hash, wa and wb are digests of all words of the windows. Equal windows have equal anchors. loops: the
    anchor is there more than once, so windows of the stretch may equal each other.
    """
    half = max(1, min_words // 2)
    kind = texts.schema["id"].dataType.simpleString()

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PASSAGE_BYTES):
            words, offsets = words_of(batch.column("text"))
            row, start = within(np.maximum(np.diff(offsets) - min_words + 1, 0))
            if not len(row):
                continue
            rolled_half, steps = rolling(words, half, BASES[0]), min_words - half + 1
            low = sliding_least(rolled_half, steps)[offsets[:-1][row] + start]
            new = np.ones(len(row), bool)
            new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            anchor, row, first, last = low[at], row[at], start[at], start[np.append(at[1:], len(row)) - 1] + 1
            ends = offsets[:-1][row]
            # the leftmost place of the anchor is in the first window, the rightmost in the last
            left, right = np.full(len(at), steps), np.zeros(len(at), np.int64)
            for d in range(steps):
                left = np.where((left == steps) & (rolled_half[ends + first + d] == anchor), d, left)
                right = np.where(rolled_half[ends + last - 1 + d] == anchor, d, right)
            digest = [rolled(w, b, ends + first, ends + last - 1 + min_words).view(np.int64) for w, b in zip((words, mixed(words + np.uint64(1))), BASES, strict=True)]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("doc").take(of), pa.array(anchor.view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(first + left != last - 1 + right), *map(pa.array, digest)], ["id", "doc", "anchor", "low", "high", "loops", "wa", "wb"])

    return stored(texts.mapInArrow(anchored, f"id {kind}, doc bigint, anchor bigint, low int, high int, loops boolean, wa bigint, wb bigint"), "stretches")


def windows(texts: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(wa, wb, id, doc, low) of the windows of the wanted stretches (doc, low, high): their digest and first word."""
    kind = texts.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PASSAGE_BYTES):
            words, offsets = words_of(batch.column("text"))
            found = batch.column("found")
            low, high = (found.flatten().field(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            run, step = within(high - low)
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))[run]
            pos = low[run] + step
            at = offsets[:-1][row] + pos
            keys = [rolled(w, b, at, at + min_words).view(np.int64) for w, b in zip((words, mixed(words + np.uint64(1))), BASES, strict=True)] if len(at) else [np.zeros(0, np.int64)] * 2
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), batch.column("id").take(of), batch.column("doc").take(of), pa.array(pos, pa.int32())], ["wa", "wb", "id", "doc", "low"])

    found = stored(wanted.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("found")), "open")
    marked = of_documents(texts, found).select("id", "doc", "text", "found")
    out = stored(marked.mapInArrow(hashed, f"wa bigint, wb bigint, id {kind}, doc bigint, low int"), "windows")
    discarded(found)
    return out


def passages(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc, lines, cuts, origins) of the texts (id, doc, text) that lose words.

    Words go if a window around them is found before. lines: line numbers that go whole; cuts: the other characters
    that go, as (low, high); origins: keys of the documents where the windows are found before.

    Stretches with equal words are settled at once: all but the first go. Windows become rows only for the first of
    each kind of stretch, and only where stretches of several kinds have one anchor, as at the ends of passages.
    """
    place = F.struct("id", "doc", "low", "high")
    all_of = stretches(texts, min_words)
    # one shuffle of the stretches gives each its anchor's sums: sums joined back would shuffle them all a second time
    same = Window.partitionBy("anchor")
    differ = (F.min("wa").over(same) != F.max("wa").over(same)) | (F.min("wb").over(same) != F.max("wb").over(same)) | F.max("loops").over(same)
    met = stored(all_of.withColumns({"n": F.count("*").over(same), "several": differ}).where("n > 1 OR several").drop("n", "loops"), "met")
    discarded(all_of)
    # repeated rows give equal places, so they are no repetition
    kinds = met.groupBy("wa", "wb").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("several").alias("several"))
    kinds = stored(kinds.select("wa", "wb", "first", (~F.col("first").eqNullSafe(F.col("last"))).alias("repeats"), "several").where("repeats OR several"), "kinds")
    firsts = kinds.where("repeats").select("wa", "wb", F.col("first.id").alias("origin"), F.col("first.doc").alias("first_doc"), F.col("first.low").alias("first_low"))
    copies = met.join(firsts, ["wa", "wb"]).where("doc <> first_doc OR low <> first_low").select("doc", "low", "high", "origin")

    loose = windows(texts, kinds.where("several").select("first.doc", "first.low", "first.high"), min_words)
    start = F.min(F.struct("id", "doc", "low")).over(Window.partitionBy("wa", "wb"))
    later = loose.withColumn("first", start).where("doc <> first.doc OR low <> first.low").select("doc", "low", (F.col("low") + 1).alias("high"), F.col("first.id").alias("origin"))
    runs = stored(copies.unionByName(later).groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("found"), F.collect_set("origin").alias("origins")), "runs")
    discarded(met, kinds, loose)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PASSAGE_BYTES):
            out = []
            found = batch.column("found")
            low, high = (found.flatten().field(c).to_numpy() for c in ("low", "high"))
            edges = found.offsets.to_numpy() - found.offsets[0].as_py()
            for k, text in enumerate(batch.column("text").to_pylist()):
                goes = np.zeros(sum(1 for _ in WORD.finditer(text)), bool)
                for a, b in zip(low[edges[k] : edges[k + 1]], high[edges[k] : edges[k + 1]], strict=True):
                    goes[a : b - 1 + min_words] = True
                lines, cuts, word, at = [], [], 0, 0
                for i, line in enumerate(text.split("\n")):
                    spans = [m.span() for m in WORD.finditer(line)]
                    own = goes[word : word + len(spans)]
                    if len(own) and own.all():
                        lines.append(i)
                    elif own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                        cuts += [{"low": at + spans[a][0], "high": at + spans[b - 1][1]} for a, b in edge.reshape(-1, 2)]
                    word, at = word + len(spans), at + len(line) + 1
                out.append((lines, cuts))
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([x for x, _ in out], pa.list_(pa.int64())), pa.array([x for _, x in out], kind), batch.column("origins")], ["doc", "lines", "cuts", "origins"])

    names = texts.select(F.array("id").alias("o")).schema["o"].dataType.simpleString()
    rows = of_documents(texts, runs).select("doc", "text", "found", "origins")
    out = stored(rows.mapInArrow(placed, f"doc bigint, lines array<bigint>, cuts array<struct<low:bigint,high:bigint>>, origins {names}").dropDuplicates(["doc"]), "passages")
    discarded(runs)
    return out


def short_repeats(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc, n_short): of the texts (id, doc, text), paragraphs of fewer words that are found at another place, word for word.

    They are classed by a 128-bit digest of their words. A sum for each class and task precedes the shuffle, and a class
    of very many is joined in parts.
    """
    units = paragraphs(min_words, shorter=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PASSAGE_BYTES):
            row, place, found = units(batch)
            words, offsets = words_of(found)
            keys = [rolled(w, b, offsets[:-1], offsets[1:]).view(np.int64) for w, b in zip((words, mixed(words + np.uint64(1))), BASES, strict=True)] if len(row) else [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), pa.array(place), *map(pa.array, keys)], ["doc", "place", "wa", "wb"])

    each = stored(texts.select("doc", "text").mapInArrow(hashed, "doc bigint, place bigint, wa bigint, wb bigint"), "short")
    # a class is at several places if documents or places differ; repeated rows give equal ones, so they are no repetition
    ends = each.groupBy("wa", "wb").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("doc", "place")))
    twice = stored(ends.where("min_doc < max_doc OR min_place < max_place").select("wa", "wb"), "short_twice")
    out = stored(each.join(broadcast_if_small(twice), ["wa", "wb"]).groupBy("doc").agg(F.count_distinct("place").alias("n_short")), "short_repeats")
    discarded(each, twice)
    return out


def repeated(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(id, n_repeated, n_removed, removed, origins, cuts, n_short, document) for each row of df.

    n_repeated: paragraphs in a component with others; removed: line numbers that go, being of near copies of
    paragraphs or whole in repeated passages; origins: keys of the documents whose paragraphs and passages stay
    instead; cuts: places (low, high) of the characters in other lines that go; n_short: shorter paragraphs that are found word for
    word at another place (greetings, headings and other lines of clean documents, so they stay); document: digest of
    key and text.
    """
    guarded(df.columns, [id_column, text], "substring_dedup")
    scheme, units = tuned(similarity / 100), paragraphs(min_words)
    rows = stored(signed(df, id_column, text, shingle, scheme, units), "paragraphs")
    nodes, found = clustered(rows, df, id_column, text, shingle, similarity, scheme, units)
    each = rows.select("id", "doc", "place", node_of().alias("node")).distinct().join(found, "node", "left").select("id", "doc", "place", F.coalesce("component", "node").alias("component"))
    each = stored(each, "each")
    discarded(rows, nodes, found)
    first = each.groupBy("component").agg(F.min(F.struct("id", "doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", F.col("first.id").alias("origin"), F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place"))
    first = stored(first, "first")
    hits = each.join(first, "component").withColumn("goes", (F.col("doc") != F.col("first_doc")) | (F.col("place") != F.col("first_place")))
    goes = lambda c: F.when(F.col("goes"), c)
    by_row = hits.groupBy("doc").agg(F.count("*").alias("n_repeated"), F.collect_list(goes(F.col("place"))).alias("places"), F.collect_set(goes(F.col("origin"))).alias("near"))
    texts = df.select(F.col(id_column).alias("id"), document(id_column, text).alias("doc"), F.col(text).alias("text"))
    found, short = passages(texts, min_words), short_repeats(texts, min_words)
    parts = found.withColumnRenamed("origins", "more")
    out = texts.select("id", "doc").join(by_row, "doc", "left").join(parts, "doc", "left").join(short, "doc", "left")
    names = parts.schema["more"].dataType
    both = lambda a, b, kind: F.array_sort(F.array_union(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind))))
    removed = both(F.flatten(F.transform("places", lambda p: F.sequence(F.floor(p / LINES), F.pmod(p, F.lit(LINES))))), F.col("lines"), "array<bigint>")
    # a line that is removed as a near copy needs no cuts, but they do no harm
    out = stored(out.select(F.col("id").alias(id_column), F.coalesce("n_repeated", F.lit(0)).cast("bigint").alias("n_repeated"), F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"), both(F.col("near"), F.col("more"), names).alias("origins"), F.coalesce("cuts", F.array().cast(parts.schema["cuts"].dataType)).alias("cuts"), F.coalesce("n_short", F.lit(0)).cast("bigint").alias("n_short"), F.col("doc").alias("document")), "repeats")
    discarded(each, first, found, short)
    return out


def without_repeats(df: DataFrame, marked: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the removed lines and cuts of `repeated` taken out of its texts."""
    fields, position = df.columns, df.columns.index(text)
    marks = marked.where("n_removed > 0 OR size(cuts) > 0").select(F.col("document").alias("mark_id"), F.col("removed").alias("mark"), F.col("cuts").alias("mark_cuts")).dropDuplicates(["mark_id"])
    named = df.toDF(*(f"c{i}" for i in range(len(fields))))
    joined = named.join(marks, document(f"c{fields.index(id_column)}", f"c{position}") == marks["mark_id"], "left").drop("mark_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, position, BATCH_BYTES):
            texts = []
            for t, gone, cuts in zip(*(batch.column(c).to_pylist() for c in (position, len(fields), len(fields) + 1)), strict=True):
                for c in reversed(cuts or []):
                    t = t[: c["low"]] + t[c["high"] :]
                texts.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in set(gone)) if t and gone else t)
            columns = list(batch.columns)[:-2]
            columns[position] = pa.array(texts, columns[position].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return joined.mapInArrow(cut, named.schema).toDF(*fields)
