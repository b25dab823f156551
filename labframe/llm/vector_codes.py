"""Vector codes by product quantisation, with metric trees of the anchors hierarchy in place of all distances.

Vectors become whole numbers and are cut into PARTS parts; each part has a codebook of ENTRIES entries, refined in
ROUNDS rounds: every part goes to its nearest entry, every entry becomes the floored mean of its parts.

The trees. Vectors are dealt out into blocks. For each block and part a metric tree is built once, middle-out: about
sqrt(n) anchors are chosen, each new one the point farthest from its anchor, and take over the points that are nearer to
them (those near their own anchor are not even looked at, by the triangle inequality). Anchors are then merged
upwards, always the two whose common ball is smallest, and large ones are cut downwards in the same way. Each ball
caches the sum and the number of its points, its centre and its radius. The trees are stored once and serve all rounds.

A round. All entries are candidates of the root. A ball inherits the candidates of its parent and drops those to
which no point of the ball can go: seen from its centre, the plane between such an entry and the most promising one
is farther away than the radius. Where one candidate is left, it owns the ball, and the cached sum and count are all
that is needed. Only points of leaves that keep several candidates are compared, with these alone. Balls are pruned
level by level for all trees of a block at once. Ties and rounding are safe: a candidate is only dropped if it is
farther by more than the rounding of doubles, and what remains is decided in whole numbers, ties to the lower index.

Spark adds up one row a task and entry; the driver only holds the codebooks (PARTS * ENTRIES rows).

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; of several lengths
that of the least id's vector counts and others are dropped; lengths that PARTS does not divide give the first parts
one component more; with fewer rows than ENTRIES the codebooks are shorter; rows of one id are rows of their own, of
which the codebooks start from the least vector; null ids come last; components so large that a squared
distance might not fit 64 bits are an error; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import broadcast_if_small, discarded, guarded, stored
from labframe.llm.pieces import expanded

#: Steps of a unit, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, and points up to which a ball is a leaf.
BLOCK, LEAF = 1024, 32
#: Share of the sizes at hand by which doubles may be off.
SLACK = 1e-9


def whole_numbers(vector: Column) -> Column:
    """Components in 1 / SCALE, rounded down; exact, as SCALE is a power of two."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))


def kept_vectors(df: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that count."""
    x = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    rows = df.select(F.col(id_column).alias("id"), F.col(label).alias("label"), x.alias("x")).where(x.isNotNull() & ~F.exists(x, bad))
    return rows.select("id", "label", whole_numbers(F.col("x")).alias("v"))


def of_length(rows: DataFrame, length: int) -> DataFrame:
    """rows (id, label, v) of vectors of this length; an error if squared distances of these may not fit 64 bits."""
    most = math.isqrt(((1 << 63) - 1) // (4 * max(length, 1)))
    large = F.exists("v", lambda c: (c > most) | (c < -most))
    return rows.where(F.size("v") == length).withColumn("v", F.when(large, F.raise_error(F.lit("vector_codes: a component is too large"))).otherwise(F.col("v")))


# ---- trees of one part of a block


def anchors(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen points, the anchor of each point): each next anchor is the point farthest from its anchor."""
    chosen, of = [0], np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < count:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gaps = np.sqrt(((x[chosen] - x[new]) ** 2).sum(1))
        # a point nearer to its anchor than half the way to the new one stays
        asked = np.flatnonzero(far > gaps[of] / 2 * (1 - SLACK))
        d = np.sqrt(((x[asked] - x[new]) ** 2).sum(1))
        moved = d < far[asked]
        far[asked[moved]], of[asked[moved]] = d[moved], len(chosen)
        chosen.append(new)
    return np.array(chosen), of


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, (first, end) of the points of each ball in this order, the two children of each ball or -1).

    Children come after their parents; the root is ball 0.
    """
    pieces: list[np.ndarray] = []
    spans: list[tuple[int, int]] = []
    below: list[tuple[int, int]] = []

    def leaf_of(points: np.ndarray, at: int) -> None:
        pieces.append(points)
        spans.append((at, at + len(points)))
        below.append((-1, -1))

    def grow(points: np.ndarray, at: int) -> int:
        """Adds the balls of these points, whose order begins at `at`; returns the number of the topmost."""
        top = len(spans)
        if len(points) <= leaf:
            leaf_of(points, at)
            return top
        own = x[points]
        chosen, of = anchors(own, max(2, int(np.sqrt(len(points)))))
        if len(chosen) < 2:  # equal points
            leaf_of(points, at)
            return top
        groups = [points[of == i] for i in range(len(chosen))]
        place(merged(own, chosen, of), groups, at)
        return top

    def place(node, groups: list[np.ndarray], at: int) -> int:
        """Adds a merged ball, depth first; a ball of one anchor is cut further. Returns the number of its points."""
        if isinstance(node, int):
            grow(groups[node], at)
            return len(groups[node])
        mine = len(spans)
        spans.append((at, at))
        below.append((-1, -1))
        left = len(spans)
        n = place(node[0], groups, at)
        right = len(spans)
        n += place(node[1], groups, at + n)
        spans[mine], below[mine] = (at, at + n), (left, right)
        return n

    grow(np.arange(len(x)), 0)
    return np.concatenate(pieces), np.array(spans, np.int64), np.array(below, np.int64)


def merged(x: np.ndarray, chosen: np.ndarray, of: np.ndarray):
    """The anchors as a binary tree of their numbers: the two with the smallest common ball are merged, until one is left."""
    k = len(chosen)
    n = np.bincount(of, minlength=k).astype(float)
    centre = np.stack([np.bincount(of, x[:, j], k) for j in range(x.shape[1])], 1) / n[:, None]
    radius = np.zeros(k)
    np.maximum.at(radius, of, np.sqrt(((x - centre[of]) ** 2).sum(1)))
    node: list = list(range(k))

    def cost(i: int) -> np.ndarray:
        gap = np.sqrt(((centre - centre[i]) ** 2).sum(1))
        return np.maximum((gap + radius + radius[i]) / 2, np.maximum(radius, radius[i]))

    costs, gone = np.stack([cost(i) for i in range(k)]), np.zeros(k, bool)
    np.fill_diagonal(costs, np.inf)
    for _ in range(k - 1):
        i, j = divmod(int(costs.argmin()), k)
        was = centre[[i, j]]
        centre[i] = (n[i] * centre[i] + n[j] * centre[j]) / (n[i] + n[j])
        radius[i] = (np.sqrt(((was - centre[i]) ** 2).sum(1)) + radius[[i, j]]).max()
        n[i] += n[j]
        node[i], node[j], gone[j] = (node[i], node[j]), None, True
        fresh = np.where(gone, np.inf, cost(i))
        fresh[i] = np.inf
        costs[i], costs[:, i] = fresh, fresh
        costs[j], costs[:, j] = np.inf, np.inf
    return node[i] if k > 1 else 0


# ---- blocks


def widths(length: int, parts: int) -> list[int]:
    return [length // parts + (i < length % parts) for i in range(parts)]


def cut(rows: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component): the parts of each row, short ones filled up with zeros."""
    w = widths(rows.shape[1], parts)
    out, at = np.zeros((parts, len(rows), max(w)), rows.dtype), 0
    for i, n in enumerate(w):
        out[i, :, :n] = rows[:, at : at + n]
        at += n
    return out


def planted(x: np.ndarray) -> dict[str, np.ndarray]:
    """The trees of the parts (part, row, component) of a block, one after the other: children are numbered over all trees.

    order: rows of each part in tree order; roots: number of each tree's root; spans, below, sums, radii: of each ball.
    """
    order, roots, spans, below, sums, radii = [], [], [], [], [], []
    for part in x:
        at, span, kids = tree(part.astype(float))
        start = sum(map(len, spans))
        roots.append(start)
        order.append(at)
        spans.append(span)
        below.append(np.where(kids < 0, -1, kids + start))
        run = np.concatenate([np.zeros((1, part.shape[1]), part.dtype), np.cumsum(part[at], 0)])
        total = run[span[:, 1]] - run[span[:, 0]]
        n = np.diff(span, axis=1)
        inside = expanded(np.arange(len(span)), span[:, 0], n[:, 0])
        ball = np.repeat(np.arange(len(span)), n[:, 0])
        radius = np.zeros(len(span))
        np.maximum.at(radius, ball, np.sqrt(((part[at][inside] - (total / n)[ball]).astype(float) ** 2).sum(1)))
        sums.append(total)
        radii.append(radius)
    return {"order": np.stack(order), "roots": np.array(roots), "spans": np.concatenate(spans), "below": np.concatenate(below), "sums": np.concatenate(sums), "radii": np.concatenate(radii)}


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    d = points - entries
    return np.einsum("...i,...i->...", d, d)


def owned(trees: dict[str, np.ndarray], x: np.ndarray, books: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(balls owned wholly, their entries, (part, row, entry) of the other points) for codebooks (part, entry, component) with valid entries (part, entry)."""
    part_of = np.repeat(np.arange(len(x)), np.diff(np.append(trees["roots"], len(trees["spans"]))))
    n = np.diff(trees["spans"], axis=1)[:, 0]
    centres, real = trees["sums"].astype(float) / np.maximum(n, 1)[:, None], books.astype(float)
    gaps = np.sqrt(((real[:, :, None] - real[:, None]) ** 2).sum(-1))
    balls, alive = trees["roots"][n[trees["roots"]] > 0], None
    alive = valid[part_of[balls]]
    mine, entry, leaves, left = [], [], [], []
    while len(balls):
        part, c, r = part_of[balls], centres[balls], trees["radii"][balls]
        d = ((c[:, None] - real[part]) ** 2).sum(-1)
        best = np.where(alive, d, np.inf).argmin(1)
        row = np.arange(len(balls))
        near, gap = d[row, best][:, None], gaps[part, best]
        scale = (c**2).sum(1)[:, None] + d + near + r[:, None] ** 2
        # every point of the ball is nearer to the best entry than to this one
        gone = d - near - 2 * r[:, None] * gap > SLACK * scale
        alive = alive & ~gone
        one = alive.sum(1) == 1
        mine.append(balls[one])
        entry.append(best[one])
        leaf = trees["below"][balls, 0] < 0
        leaves.append(balls[~one & leaf])
        left.append(alive[~one & leaf])
        down = ~one & ~leaf
        balls, alive = trees["below"][balls[down]].ravel(), np.repeat(alive[down], 2, 0)
    leaf, alive = np.concatenate([np.zeros(0, np.int64), *leaves]), np.concatenate([np.zeros((0, books.shape[1]), bool), *left])
    ball = np.repeat(np.arange(len(leaf)), n[leaf])
    rows = expanded(np.arange(len(leaf)), trees["spans"][leaf, 0], n[leaf])
    part, alive = part_of[leaf][ball], alive[ball]
    rows = trees["order"][part, rows]
    chosen = np.zeros(len(rows), np.int64)
    for p in np.unique(part):
        of = np.flatnonzero(part == p)
        chosen[of] = nearest(x[p, rows[of]], books[p], alive[of])
    return np.concatenate([np.zeros(0, np.int64), *mine]), np.concatenate([np.zeros(0, np.int64), *entry]), (part, rows, chosen)


def nearest(points: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The nearest of each point's candidates, the lowest of equal ones. Doubles below 2 ** 53 are whole numbers, so small ones are exact."""
    largest = max((max(int(a.max()), -int(a.min())) for a in (points, entries) if a.size), default=0)
    if 4 * largest**2 * max(points.shape[1], 1) < 1 << 53:
        a, b = points.astype(float), entries.astype(float)
        return np.where(alive, (b**2).sum(1) - 2 * (a @ b.T), np.inf).argmin(1)
    most = np.iinfo(np.int64).max
    return np.stack([np.where(alive[:, k], squared(points, e), most) for k, e in enumerate(entries)], 1).argmin(1)


def block_sums(trees: dict[str, np.ndarray], x: np.ndarray, books: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts (part, entry), sums (part, entry, component)) of a block."""
    balls, entry, (part, row, k) = owned(trees, x, books, valid)
    part_of = np.repeat(np.arange(len(x)), np.diff(np.append(trees["roots"], len(trees["spans"]))))
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    np.add.at(counts, (part_of[balls], entry), np.diff(trees["spans"][balls], axis=1)[:, 0])
    np.add.at(sums, (part_of[balls], entry), trees["sums"][balls])
    np.add.at(counts, (part, k), 1)
    np.add.at(sums, (part, k), x[part, row])
    return counts, sums


def block_codes(trees: dict[str, np.ndarray], x: np.ndarray, books: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The entry of each part and row."""
    balls, entry, (part, row, k) = owned(trees, x, books, valid)
    part_of = np.repeat(np.arange(len(x)), np.diff(np.append(trees["roots"], len(trees["spans"]))))
    out = np.zeros(x.shape[:2], np.int64)
    n = np.diff(trees["spans"][balls], axis=1)[:, 0]
    of = np.repeat(np.arange(len(balls)), n)
    inside = expanded(np.arange(len(balls)), trees["spans"][balls, 0], n)
    at = part_of[balls][of]
    out[at, trees["order"][at, inside]] = entry[of]
    out[part, row] = k
    return out


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in as few bytes each as they need, and how many."""
    for width in (2, 4, 8):
        if not x.size or (x.min() >= -(1 << 8 * width - 1) and x.max() < 1 << 8 * width - 1):
            return x.astype(f"<i{width}").tobytes(), width
    raise OverflowError


def blocks(rows: DataFrame, length: int, parts: int, block: int) -> DataFrame:
    """The stored blocks of rows (id, label, v): ids, labels, components by part, and the trees. A block is what arrives in a task, `block` rows at a time."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            while held and (size >= block or batch is None and size):
                whole = pa.Table.from_batches(held).combine_chunks()
                one, rest = whole.slice(0, block), whole.slice(block)
                held, size = rest.to_batches() if rest.num_rows else [], rest.num_rows
                yield packed(one)

    def packed(table: pa.Table) -> pa.RecordBatch:
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, length)
        x = cut(flat, parts)
        trees = planted(x)
        points, width = _packed(x)
        one = lambda value, kind: pa.array([value], kind)
        ids, labels = (table.column(c).combine_chunks() for c in ("id", "label"))
        offsets = pa.array([0, table.num_rows], pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, labels), one(points, pa.binary()), one([width, x.shape[2]], pa.list_(pa.int32())), one([*trees["roots"].tolist(), len(trees["spans"])], pa.list_(pa.int32()))]
        columns += [one(trees["order"].astype("<i4").tobytes(), pa.binary()), *(one(trees[c].astype(t).tobytes(), pa.binary()) for c, t in (("spans", "<i4"), ("below", "<i4"), ("sums", "<i8"), ("radii", "<f8")))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "points", "sizes", "nodes", "order", "spans", "below", "sums", "radii"])

    ddl = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, sizes array<int>, nodes array<int>, order binary, spans binary, below binary, sums binary, radii binary"
    return stored(rows.select("id", "label", "v").mapInArrow(build, ddl), "blocks")


TREE = ["points", "sizes", "nodes", "order", "spans", "below", "sums", "radii"]


def unpacked(row: dict, parts: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(trees, (part, row, component)) of a stored block."""
    width, components = row["sizes"]
    order = np.frombuffer(row["order"], "<i4").reshape(parts, -1).astype(np.int64)
    x = np.frombuffer(row["points"], f"<i{width}").astype(np.int64).reshape(parts, order.shape[1], components)
    two = {c: np.frombuffer(row[c], "<i4").reshape(-1, 2).astype(np.int64) for c in ("spans", "below")}
    trees = {"order": order, "roots": np.array(row["nodes"][:-1]), **two, "sums": np.frombuffer(row["sums"], "<i8").reshape(len(two["spans"]), components), "radii": np.frombuffer(row["radii"], "<f8")}
    return trees, x


def refined(stored_blocks: DataFrame, books: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floored means, unused entries as they were."""
    parts, _, components = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                more = block_sums(*unpacked(batch.slice(at, 1).to_pylist()[0], parts), books, valid)
                counts, sums = counts + more[0], sums + more[1]
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = stored_blocks.select(*TREE).mapInArrow(add, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(components)))
    out = books.copy()
    for r in total.collect():  # one row an entry
        out[r.part, r.entry] = [int(r[f"s{j}"]) // r.n for j in range(components)]
    return out


def vector_codes(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row that counts."""
    guarded(df.columns, [id_column, vector, label], "vector_codes")
    rows = kept_vectors(df, id_column, vector, label)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_column, label)}
    least = rows.select(F.col("id").alias("of")).distinct().orderBy(F.col("of").asc_nulls_last()).limit(entries)
    first = rows.join(F.broadcast(least), F.col("id").eqNullSafe(F.col("of"))).groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).collect()
    length = len(first[0].v) if first else 0
    same = [r.v for r in first if len(r.v) == length]
    books = cut(np.array(same, np.int64).reshape(len(same), length), parts)
    k = books.shape[1]
    valid = np.ones(books.shape[:2], bool)
    made = blocks(of_length(rows, length), length, parts, block)
    for _ in range(rounds):
        books = refined(made, books, valid)
    w = widths(length, parts)
    listed = ",".join(str(c) for p in range(parts) for e in range(k) for c in books[p, e, : w[p]].tolist())
    digest = hashlib.sha256(listed.encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, "label", "code", "error"]
        for batch in batches:
            for at in range(batch.num_rows):
                trees, x = unpacked(batch.select(TREE).slice(at, 1).to_pylist()[0], parts)
                codes = block_codes(trees, x, books, valid)
                error = squared(x, books[np.arange(parts)[:, None], codes]).sum(0)
                hexed = codes.T.astype(np.uint8).tobytes().hex()
                text = [hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
                ids, labels = (batch.column(c).slice(at, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error, pa.int64())], names)

    coded = stored(made.mapInArrow(encode, f"`{id_column}` {kinds[id_column]}, label {kinds[label]}, code string, error bigint"), "codes")
    discarded(made)
    by_label = coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    out = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("label_")))
    return out.select(id_column, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
