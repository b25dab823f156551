"""MinHash near-duplicates with tensored banding.

Two small collections of bands are computed, A with 12 bands of 3 minhashes and B with 8 bands of 2. Table (i, j) has
the key (A_i, B_j), so 96 tables of 5 minhashes come from 52 minhashes instead of 480. Two sets of similarity 0.8 miss each other in
all tables with a probability of about 5 in 10,000, at 0.85 of 2 in 100,000.

Rows with equal sets are one class first, so copies never meet in a table. In each bucket of a table only the link
to its centre, the member of least hash, is looked at; the links are verified on full sets, and components follow.
Where a bucket then still holds several components, its members are compared with each other all the same: blocks of
bounded size are dealt out and compared inside an Arrow function, which returns one link for a member and component.
In a bucket of more than some blocks, members meet by their rarest shingles instead, of which similar sets share one
(and by two of them where one is not rare at all). Large groups are compared whole, while no pairs but verified ones
and those with centres become rows; a centre's set is sent once to each block of its members.

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing; repeated
rows (also of one key) each get their class; null keys are classed by text like others, and a row without a key is
kept unless its group has a key; columns other than key and
text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import broadcast_if_small, by_bytes, components, discarded, guarded, merged, stored
from labframe.llm.pieces import expanded

#: Words in a shingle and the least similarity, in hundredths, unless the caller says otherwise.
SHINGLE, SIMILARITY = 5, 80


@dataclass(frozen=True)
class Scheme:
    """Two collections of bands; every pair of an A band and a B band is a table, or every A band if there are no B bands."""

    a_bands: int
    a_rows: int
    b_bands: int = 0
    b_rows: int = 0

    @property
    def hashes(self) -> int:
        return self.a_bands * self.a_rows + self.b_bands * self.b_rows


TENSORED = Scheme(12, 3, 8, 2)
#: Members in a block of the comparison of buckets; blocks of a bucket up to which comparing them one by one gives fewer
#: rows (two for a member and block at most) than meeting by rare shingles (up to a fifth of a set's size for a member).
BLOCK, WIDE = 256, 64
#: The band that stands for a rare shingle.
RARE = -1
BATCH_BYTES = 2_000_000
#: Band keys that a task makes and counts, most of which differ: about 100 MB.
TASK_KEYS = 1_000_000
#: Estimates below this share of equal minhashes are dropped before verification: at 0.8 over five deviations away.
LEAST_ESTIMATE = 0.45
#: Fixed value: an odd base of the words' hashes.
BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(20240311).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 64), np.int64).astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes, taken from sums over all strings at once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = words.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * np.cumprod(np.full(len(data), BASE, np.uint64)))])
        down = np.cumprod(np.full(len(data) + 1, pow(BASE, -1, 1 << 64), np.uint64))
        return mixed((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in turn, A-Z lower-cased, offsets by text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
    offsets = offsets - offsets[0]
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    at = words.indices.to_numpy()
    keep = at != blank
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    # the distinct words are lower-cased: this kernel misreads arrays that begin within a buffer, as slices of batches do
    return word_hashes(pc.ascii_lower(words.dictionary))[at[keep]] if len(at) else np.zeros(0, np.uint64), kept


def sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, A-Z lower-cased, offsets by text)."""
    h, kept = words_of(texts)
    n = np.diff(kept)
    # a shingle's hash: Horner's rule over its words' hashes
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    first = kept[:-1][row] + np.arange(len(row)) - (ends - count)[row]
    width = None if (n >= shingle).all() else np.minimum(n, shingle)[row]
    value = np.zeros(len(row), np.uint64)
    padded = np.concatenate([h, np.zeros(shingle, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(shingle):
            longer = mixed(value * np.uint64(0x9E3779B97F4A7C15) + padded[first + k] + np.uint64(1))
            value = longer if width is None else np.where(k < width, longer, value)
    if len(row) > 50 * len(n):
        for lo, hi in zip(ends - count, ends, strict=True):
            value[lo:hi].sort()
    else:  # the same for many small sets at once
        value = value[np.lexsort((value, row))]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def minhashes(values: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """That many minima for each set; empty sets have zeros."""
    n, out = np.diff(offsets), np.zeros((len(offsets) - 1, hashes), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(hashes):
                out[some, k] = np.minimum.reduceat(mixed(values * _MIX[0, k] + _MIX[1, k]), offsets[:-1][some])
    return out


def bands(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys of the A bands, then of the B bands, for each row of minhashes."""
    widths = [scheme.a_rows] * scheme.a_bands + [scheme.b_rows] * scheme.b_bands
    out, at = np.zeros((len(hashes), len(widths)), np.uint64), 0
    with np.errstate(over="ignore"):
        for b, width in enumerate(widths):
            for k in range(at, at + width):
                out[:, b] = mixed(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + hashes[:, k] + np.uint64(b + 1))
            at += width
    return out


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set, from sums of mixed members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values * np.uint64(m) + np.uint64(1)))]) for m in (3, 0x9E3779B97F4A7C15)]
        return [mixed((d[offsets[1:]] - d[offsets[:-1]]) + np.diff(offsets).astype(np.uint64)).view(np.int64) for d in sums]


Units = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, pa.Array]]


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place in the row, text) of what is compared: here each row's whole text."""
    return np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), batch.column("text")


def document(id_column: str, text: str) -> Column:
    """A digest of key and text: what tells documents apart, also those without a key."""
    return F.xxhash64(id_column, text)


def signed(df: DataFrame, id_column: str, text: str, shingle: int, scheme: Scheme, units: Units = whole) -> DataFrame:
    """(id, doc, place, n, class_a, class_b, bands, sketch): a digest of key and text, set size, a 128-bit digest of the set, band keys, a byte of each minhash."""
    kind = df.schema[id_column].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            row, place, texts = units(batch)
            values, offsets = sets(texts, shingle)
            n, hashes = np.diff(offsets), minhashes(values, offsets, scheme.hashes)
            keys = bands(hashes, scheme)
            low = np.ascontiguousarray((hashes & np.uint64(255)).astype(np.uint8))
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(scheme.hashes), len(n), [None, pa.py_buffer(low)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("id", "doc")), pa.array(place), pa.array(n), *map(pa.array, digests(values, offsets)), lists(keys.ravel(), np.arange(len(n) + 1) * keys.shape[1]), sketch], ["id", "doc", "place", "n", "class_a", "class_b", "bands", "sketch"])

    rows = df.select(F.col(id_column).alias("id"), document(id_column, text).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"id {kind}, doc bigint, place bigint, n bigint, class_a bigint, class_b bigint, bands array<bigint>, sketch binary")


def similarity_estimate(a: str, b: str, hashes: int):
    """Share of equal minhashes by their lowest bytes, of two binary columns."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(s), np.uint8).reshape(-1, hashes) for s in (x, y)]
        return pd.Series((both[0] == both[1]).mean(1))

    return share(F.col(a), F.col(b))


def verified(pairs: DataFrame, full: DataFrame, similarity: int, scheme: Scheme) -> DataFrame:
    """Those of pairs (a, b) whose full sets (node, members) are similar enough.

    The members of a centre are dealt out in blocks, and the centre's set is sent once to each block, not once to each pair.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = stored(blocks, "blocks")
    cell = lambda block: F.xxhash64("a", block).alias("cell")
    left = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(F.col("a").alias("node"), F.lit(1).alias("role"), cell(F.col("block")))
    right = pairs.join(merged(blocks), "a").select(F.col("b").alias("node"), F.lit(2).alias("role"), cell(F.pmod(F.xxhash64("b"), "blocks").cast("int")))
    cells = stored(left.unionByName(right), "pair_cells")
    groups = max(1, cells.count() // (2 * BLOCK))
    rows = cells.join(merged(full), "node").select("cell", F.lit(RARE).alias("band"), "role", "node", F.col("node").alias("component"), F.array(F.lit(0).cast("bigint")).alias("bands"), "members")
    out = stored(compared(rows, groups, similarity, scheme), "verified")
    discarded(blocks, cells)
    return out


def compared(members: DataFrame, groups: int, similarity: int, scheme: Scheme) -> DataFrame:
    """Links (a, b) inside cells: members has (cell, band, role, node, component, bands, members).

    Role 1 rows are compared with role 2 rows of their cell and another component, if the cell's band is the first
    that they share and some B band, if there are any, is shared too (so each pair is compared in one cell), or the
    cell is one of a rare shingle. One link
    comes out for each role 1 row and component. Cells are small and many, so a call gets about `groups`-th of them.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.role == 1], rows[rows.role == 2]
        out = [np.zeros((0, 2), np.int64)]
        if len(left) and len(right):
            lb, rb = np.stack(left.bands.to_list()), np.stack(right.bands.to_list())
            ls, rs = left.members.str.len().to_numpy(), right.members.str.len().to_numpy()
            ln, rn, lc, rc = left.node.to_numpy(), right.node.to_numpy(), left.component.to_numpy(), right.component.to_numpy()
            lcell, rcell, band = left.cell.to_numpy(), right.cell.to_numpy(), left.band.to_numpy()
            known, rank = np.unique(np.concatenate([*left.members.to_list(), *right.members.to_list()]), return_inverse=True)
            have = np.sort(np.repeat(np.arange(len(left)), ls) * len(known) + rank[: ls.sum()])
            flat, starts = rank[ls.sum() :], np.cumsum(rs) - rs
            for lo in range(0, len(left), 128):
                i = slice(lo, lo + 128)
                a, b = np.nonzero((lcell[i, None] == rcell) & (lc[i, None] != rc) & (100 * np.minimum(ls[i, None], rs) >= similarity * np.maximum(ls[i, None], rs)))
                a += lo
                same = lb[a, : scheme.a_bands] == rb[b, : scheme.a_bands]
                good = same[np.arange(len(a)), band[a]] & (same.argmax(1) == band[a])
                if scheme.b_bands:
                    good &= (lb[a, scheme.a_bands :] == rb[b, scheme.a_bands :]).any(1)
                good |= band[a] == RARE
                a, b = a[good], b[good]
                for some in np.array_split(np.arange(len(a)), int(rs[b].sum()) // 1_000_000 + 1):
                    if not len(some):
                        continue
                    x, y = a[some], b[some]
                    asked = np.repeat(x, rs[y]) * len(known) + flat[expanded(np.arange(len(y)), starts[y], rs[y])]
                    found = have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked
                    common = np.add.reduceat(found.astype(np.int64), np.cumsum(rs[y]) - rs[y])
                    near = 100 * common >= similarity * (ls[x] + rs[y] - common)
                    x, y = x[near], y[near]
                    _, first = np.unique(np.stack([x, rc[y]], 1), axis=0, return_index=True)
                    out.append(np.stack([ln[x[first]], rn[y[first]]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return members.groupBy(F.pmod("cell", F.lit(groups)).alias("group")).applyInPandas(compare, "a bigint, b bigint")


def set_table(df: DataFrame, nodes: DataFrame, id_column: str, text: str, shingle: int, units: Units = whole) -> DataFrame:
    """(node, members): the full sets of the given nodes (node, doc, place, class_a, class_b)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            row, place, texts = units(batch)
            wanted = np.flatnonzero(place == batch.column("place").to_numpy()[row])
            row, texts = pa.array(row[wanted]), texts.take(pa.array(wanted))
            values, offsets = sets(texts, shingle)
            right = [pc.equal(batch.column(c).take(row), pa.array(d)) for c, d in zip(("class_a", "class_b"), digests(values, offsets), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(row), lists(values, offsets)], ["node", "members"]).filter(pc.and_(*right))

    rows = df.select(document(id_column, text).alias("doc"), F.col(text).alias("text"))
    rows = merged(rows).join(broadcast_if_small(nodes), "doc").select("node", "place", "class_a", "class_b", "text")
    return stored(rows.mapInArrow(collect, "node bigint, members array<bigint>").dropDuplicates(["node"]), "sets")


#: A class of equal sets is a node, known by a hash of the digest.
NODE = ("class_a", "class_b")


def node_of() -> Column:
    return F.xxhash64(*NODE)


def clustered(rows: DataFrame, df: DataFrame, id_column: str, text: str, shingle: int, similarity: int, scheme: Scheme, units: Units = whole) -> tuple[DataFrame, DataFrame]:
    """(nodes, components of linked nodes) for a table of `signed`. A node without links is in no component."""
    used: list[DataFrame] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        used.append(stored(df, name))
        return used[-1]

    some = rows.where("n > 0")
    # sums by a key are stored before they are joined, so that both sides of the join are exchanges and a hot key can be split
    first = hold(some.groupBy(*NODE).agg(F.min(F.struct("doc", "place")).alias("first"), F.min("id").alias("least")).select(*NODE, "first.doc", "first.place", "least"), "first")
    # repeated rows lie together after the join, so they go without another shuffle
    nodes = some.join(merged(first), [*NODE, "doc", "place"]).dropDuplicates([*NODE, "doc", "place"])
    nodes = stored(nodes.select(node_of().alias("node"), F.col("least").alias("id"), "doc", "place", *NODE, "n", "bands", "sketch"), "nodes")
    place = ["node", "doc", "place", *NODE]

    # dealt out by number, as the files of some tasks would hold keys for all of an executor's memory
    tasks = nodes.count() * scheme.a_bands * max(1, scheme.b_bands) // TASK_KEYS + 1
    keyed = nodes.select("node", "bands").repartition(tasks, "node").select("node", "bands", F.posexplode(F.slice("bands", 1, scheme.a_bands)).alias("i", "a"))
    if scheme.b_bands:
        keyed = keyed.select("node", "i", "a", F.posexplode(F.slice("bands", scheme.a_bands + 1, scheme.b_bands)).alias("j", "b")).select("node", F.xxhash64("i", "a", "j", "b").alias("key"))
    else:
        keyed = keyed.select("node", F.xxhash64("i", "a").alias("key"))
    centres = hold(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre"), "centres")
    stars = hold(keyed.join(merged(centres), "key").where("node <> centre").select("key", "centre", "node"), "stars")

    info = nodes.select("node", "sketch", "n")
    met = hold(stars.select("centre", "node").distinct(), "met")
    pairs = met.join(merged(info.toDF("centre", "x", "nx")), "centre").join(merged(info.toDF("node", "y", "ny")), "node")
    pairs = pairs.where(100 * F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
    pairs = hold(pairs.withColumn("estimate", similarity_estimate("x", "y", scheme.hashes)).where(F.col("estimate") >= LEAST_ESTIMATE).select(F.col("centre").alias("a"), F.col("node").alias("b"), "estimate"), "pairs")
    touched = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = set_table(df, hold(nodes.select(*place).join(merged(touched), "node", "left_semi"), "touched"), id_column, text, shingle, units)
    used.append(full)

    # the most promising link of each member, then those between components that remain
    best = hold(pairs.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b"), "best")
    links = verified(best, full, similarity, scheme)
    used.append(links)
    found = components(links)
    used.append(found)
    rest = labelled(pairs.select("a", "b"), found).where("ca <> cb").select("a", "b")
    used.append(verified(rest.join(merged(best), ["a", "b"], "left_anti"), full, similarity, scheme))
    found = joined(found, used[-1])
    used.append(found)

    # components that share a bucket, but whose members were only compared with its centre, if at all
    open_pairs = labelled(met.toDF("a", "b"), found).where("ca <> cb").select("a", "b")
    keys = stars.toDF("key", "a", "b").join(merged(open_pairs), ["a", "b"], "left_semi").select("key").distinct()
    inside = stars.join(merged(keys), "key", "left_semi")
    inside = hold(inside.select("node").unionByName(inside.select(F.col("centre").alias("node"))).distinct(), "open")
    missing = inside.join(merged(full.select("node")), "node", "left_anti")
    sets_of = full.join(merged(inside), "node", "left_semi")
    if missing.limit(1).count():
        used.append(set_table(df, hold(nodes.select(*place).join(merged(missing), "node", "left_semi"), "missing"), id_column, text, shingle, units))
        sets_of = sets_of.unionByName(used[-1])
    member = nodes.join(merged(inside), "node", "left_semi").select("node", "bands").join(merged(found), "node", "left").withColumn("component", F.coalesce("component", "node")).join(merged(sets_of), "node")
    found = joined(found, hold(residual(hold(member, "members"), similarity, scheme, hold), "links"))
    discarded(*used)
    return nodes, found


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df; ids are whole numbers. component_id is the least id reachable over links."""
    guarded(df.columns, [id_column, text], "near_duplicates")
    rows = stored(signed(df, id_column, text, shingle, TENSORED), "signed")
    nodes, found = clustered(rows, df, id_column, text, shingle, similarity, TENSORED)
    named = nodes.select("node", "id").join(merged(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "named")
    ids = stored(named.groupBy("component").agg(F.min("id").alias("component_id")), "ids")
    least = stored(named.join(merged(ids), "component").select("node", "component_id"), "least")
    discarded(nodes, found, named, ids)
    out = rows.select("id", "n", F.when(F.col("n") > 0, node_of()).alias("node")).join(merged(least), "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` after more links (a, b): only the components are linked, so the work grows with what is new."""
    new = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = found.unionByName(new.join(merged(found), "node", "left_anti").select("node", F.col("node").alias("component")))
    larger = components(labelled(links, found).select("ca", "cb"), "ca", "cb")
    out = known.join(merged(larger.toDF("component", "to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = stored(out, "components")
    discarded(larger)
    return out


def labelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (a, b) with their components (ca, cb); a node without links is a component of its own."""
    out = pairs.join(merged(found.toDF("a", "ca")), "a", "left").join(merged(found.toDF("b", "cb")), "b", "left")
    return out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def ordered(member: DataFrame, similarity: int, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component, reach, rare) for each set of member (node, component, members): its rarest shingles (place, m) that others have too.

    Shingles are ordered by how many of these sets have them, exactly. Two similar sets share at least so many that
    their first common shingle is among the first `reach` of both, and their second among the first reach + 1; places
    count all shingles of a set, those that nobody else has being the first.
    """
    n = F.size("members")
    loose = member.select("node", "component", n.alias("n"), F.explode("members").alias("m"))
    counts = hold(loose.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"), "shingle_counts")
    shared = loose.join(merged(counts), "m").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "m"))).alias("s"))
    reach = (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") / 100) + 1).cast("int")
    placed = F.transform("s", lambda x, i: F.struct((F.col("n") - F.size("s") + i).alias("place"), x["m"].alias("m")))
    return hold(shared.select("node", "component", reach.alias("reach"), F.filter(placed, lambda x: x["place"] <= reach).alias("rare")), "ordered")


def first_meetings(sets: DataFrame) -> DataFrame:
    """(node, component, bucket, place): where a set can meet a similar one by their first common shingle."""
    return sets.select("node", "component", "reach", F.inline("rare")).where("place < reach").select("node", "component", F.col("m").alias("bucket"), "place")


def second_meetings(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for rows of `first_meetings`, by the next common shingle besides."""
    later = F.filter("rare", lambda x: x["place"] > F.col("place"))
    rows = met.join(merged(sets.select("node", "rare")), "node").select("node", "component", "bucket", F.inline(F.transform(later, lambda x: F.struct(x["m"].alias("m")))))
    return rows.select("node", "component", F.xxhash64("bucket", "m").alias("bucket"))


def residual(member: DataFrame, similarity: int, scheme: Scheme, hold: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Links (a, b) between components among members (node, bands, component, members) that share a table's key, by blocks.

    A bucket of more than WIDE blocks is not compared block by block: its members meet where they share one of their
    rarest shingles, as all similar ones do, and where that is still a wide bucket, by their two rarest. What is wide
    even then, sets that are alike in all but few shingles and yet not linked, is compared in blocks. So a row has at
    most WIDE copies in a bucket of the first two kinds. Members that meet by rare shingles are compared whatever their
    bands, so a few links more can be found there.
    """
    key = ["band", "bucket"]
    spread = member.select("node", "component", F.posexplode(F.slice("bands", 1, scheme.a_bands)).alias("band", "bucket"))

    def sized(spread: DataFrame, name: str) -> DataFrame:
        sizes = spread.groupBy(*key, "component").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy(*key).agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
        return hold(sizes.select(*key, F.col("top.component").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks_b"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("blocks_a")), name)

    sizes = sized(spread, "sizes")
    wide = sizes.where(F.col("blocks_b") > WIDE).select(*key)
    spread = spread.join(merged(sizes.where(F.col("blocks_b") <= WIDE)), key)
    if wide.limit(1).count():
        crowd = hold(member.select("node", F.posexplode(F.slice("bands", 1, scheme.a_bands)).alias(*key)).join(wide, key, "left_semi").select("node").distinct(), "crowd")
        sets = ordered(hold(member.join(merged(crowd), "node", "left_semi"), "wide"), similarity, hold)
        rare = hold(first_meetings(sets).withColumn("band", F.lit(RARE)), "rare")
        rare_sizes = sized(rare, "rare_sizes")
        again = rare_sizes.where(F.col("blocks_b") > WIDE).select(*key)
        spread = spread.unionByName(rare.drop("place").join(merged(rare_sizes.where(F.col("blocks_b") <= WIDE)), key))
        if again.limit(1).count():
            rarer = hold(second_meetings(rare.join(again, key, "left_semi"), sets).withColumn("band", F.lit(RARE)), "rarer")
            spread = spread.unionByName(rarer.join(merged(sized(rarer, "rarer_sizes")), key))
    # role 1: rows outside the bucket's largest component, with every block of role 2; role 2: all rows
    role1 = spread.where("component <> top").select(*key, "node", F.lit(1).alias("role"), F.pmod(F.xxhash64("node"), "blocks_a").cast("int").alias("block_a"), F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block_b"))
    role2 = spread.select(*key, "node", F.lit(2).alias("role"), F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block_a"), F.pmod(F.xxhash64("node", F.lit(1)), "blocks_b").cast("int").alias("block_b"))
    cells = hold(role1.unionByName(role2).select("node", "role", "band", F.xxhash64(*key, "block_a", "block_b").alias("cell")), "cells")
    return compared(cells.join(merged(member), "node"), max(1, cells.count() // (2 * BLOCK)), similarity, scheme)
