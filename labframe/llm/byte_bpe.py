"""Byte-level BPE encoding and decoding.

The method: words are byte arrays, a fold merges the leftmost pair of least rank until none is left, the rank map
is a literal, distinct words are merged once, decoding concatenates binary pieces. `merged` and `decoded` are that in
Spark's higher-order functions, with the rank map as two literal arrays that hash the mergeable pairs without
collision (a literal map would be searched from end to end at each look-up).

`encoded` runs the same fold over the distinct words of a batch of texts in an Arrow function: all words of a batch
take their next merge at once, from the same tables. The higher-order fold was measured at 148 microseconds a word,
which for the 15 to 26 million distinct words of such batches in 0.5 GB is beyond the time allowed; see README.md. Nothing is shuffled, and a hot source or
a long text is cut like any other. Words over LONG_WORD bytes (runs without any break) are merged with a heap.

Defined results: null and empty texts have no tokens and decode to no bytes; repeated rows are encoded each; extra
columns are carried along as they are, under their own names, but for one named as the ids, which is replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labframe.llm.common import by_bytes, guarded
from labframe.llm.pieces import distinct_parts, expanded

#: Bytes of text in a batch, whose distinct words are merged once.
BATCH_BYTES = 4_000_000
#: Longest word, in bytes, for the fold over a batch.
LONG_WORD = 200
#: Above all ranks and ids; three of them multiplied stay below 2^63.
NO_RANK = 1 << 17
#: Of the literal pair table: groups that share a shift, and the multipliers of its two hashes.
GROUPS, STEP, LEAP = 1 << 16, 9973, 100003


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, a small fixed file that the driver can read."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def pair_table(ranks: tuple[tuple[bytes, int], ...]) -> tuple[list[int], list[int]]:
    """(shifts, slots): a perfect hash of the pairs that merge. Pair (a, b) is in group a * STEP + b modulo the shifts'
    number, and its slot, (a * LEAP + b + shift of the group) modulo the slots' number, holds pair * 2^17 + rank; empty slots -1."""
    known = dict(ranks)
    pairs = [(a, b, rank) for token, rank in ranks for i in range(1, len(token)) if (a := known.get(token[:i])) is not None and (b := known.get(token[i:])) is not None]
    if max(known.values()) >= NO_RANK:
        raise ValueError(f"ranks of {NO_RANK} and more are not provided for")
    size = 1 << (3 * len(pairs)).bit_length() - 1
    groups: dict[int, list[tuple[int, int]]] = {}
    for a, b, rank in pairs:
        groups.setdefault((a * STEP + b) % GROUPS, []).append(((a * LEAP + b) % size, (a * NO_RANK + b) * NO_RANK + rank))
    shifts, slots, draw = [0] * GROUPS, [-1] * size, random.Random(0)
    for g in sorted(groups, key=lambda g: (-len(groups[g]), g)):
        if len({at for at, _ in groups[g]}) < len(groups[g]):
            raise ValueError("two pairs of a group share a slot; choose another LEAP")
        while any(slots[(at + shifts[g]) % size] >= 0 for at, _ in groups[g]):
            shifts[g] = draw.randrange(size)
        for at, value in groups[g]:
            slots[(at + shifts[g]) % size] = value
    return shifts, slots


@lru_cache(maxsize=2)
def numpy_table(ranks: tuple[tuple[bytes, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    shifts, slots = pair_table(ranks)
    return np.array(shifts), np.array(slots)


def literal(values: list) -> Column:
    """A literal array of whole numbers; the optimizer folds it into one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def literal_strings(values: list[str]) -> Column:
    return F.split(F.lit(",".join(values)), ",")


def merged(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word given as an array of bytes (0 to 255)."""
    shifts, slots = pair_table(tuple(ranks.items()))
    first, shift, slot, size = literal([ranks[bytes([i])] for i in range(256)]), literal(shifts), literal(slots), len(slots)

    def rank(a: Column, b: Column) -> Column:
        found = F.get(slot, ((F.get(shift, ((a * STEP + b) % GROUPS).cast("int")) + a * LEAP + b) % size).cast("int"))
        return F.when(F.shiftright(found, 17) == a * NO_RANK + b, found.bitwiseAND(F.lit(NO_RANK - 1))).otherwise(F.lit(NO_RANK).cast("bigint"))

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def state(ids: Column, ranks: Column) -> Column:
        return F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def step(s: Column, _: Column) -> Column:
        def merge(best: Column, at: Column) -> Column:  # at: 1 for the first pair
            ids, old = s["ids"], s["ranks"]
            n = F.size(old)
            left = F.when(at > 1, F.array(rank(F.get(ids, at - 2), best))).otherwise(F.slice(old, 1, 0))
            right = F.when(at < n, F.array(rank(best, F.get(ids, at + 1)))).otherwise(F.slice(old, 1, 0))
            return state(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, n)), F.concat(F.slice(old, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(old, at + 2, n)))

        return F.when(F.size(s["ranks"]) == 0, s).otherwise(bind(F.array_min(s["ranks"]), lambda best: F.when(best >= NO_RANK, s).otherwise(merge(best, F.array_position(s["ranks"], best).cast("int")))))

    start = F.transform(word, lambda b: F.get(first, b.cast("int")))
    begun = bind(start, lambda ids: state(ids, F.transform(F.slice(ids, F.lit(2), F.size(ids)), lambda b, i: rank(F.get(ids, i), b))))
    return F.aggregate(F.slice(word, F.lit(2), F.size(word)), begun, step, lambda s: s["ids"])


def by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges of a long word in n log n steps."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (m := after[k]) < n and word[k : end[m]] in ranks:
                heapq.heappush(heap, (ranks[word[k : end[m]]], k, end[m]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def all_merged(words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, how many each has): the fold of `merged` for all words at once."""
    shifts, slots = numpy_table(tuple(ranks.items()))
    first = np.array([ranks[bytes([i])] for i in range(256)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts, flat = np.cumsum(lengths) - lengths, first[np.frombuffer(b"".join(words), np.uint8)]
    counts, out = np.zeros(len(words), np.int64), np.full(len(flat), -1, np.int64)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = slots[(shifts[(a * STEP + b) & (GROUPS - 1)] + a * LEAP + b) & (len(slots) - 1)]
        return np.where((found >> 17 == a * NO_RANK + b) & (b >= 0), found & (NO_RANK - 1), NO_RANK)

    for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, 40), (40, 80), (80, LONG_WORD)):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        for rows in np.array_split(rows, len(rows) * high // 1_000_000 + 1):  # noqa: B020
            if not len(rows):
                continue
            at = starts[rows][:, None] + np.arange(high + 1)
            ids = np.where(np.arange(high + 1) < lengths[rows][:, None], flat[np.minimum(at, len(flat) - 1)], -1)
            while len(rows):
                found = rank(ids[:, :-1], ids[:, 1:])
                best = found.argmin(1)
                least = found[np.arange(len(rows)), best]
                if (done := least == NO_RANK).any():
                    have = ids[done] >= 0
                    counts[rows[done]] = have.sum(1)
                    out[(starts[rows[done]][:, None] + np.arange(ids.shape[1]))[have]] = ids[done][have]
                    rows, ids, best, least = rows[~done], ids[~done], best[~done], least[~done]
                ids[np.arange(len(rows)), best] = least
                columns = np.arange(ids.shape[1] - 1)
                ids[:, 1:] = np.where(columns >= best[:, None], np.concatenate([ids[:, 2:], np.full((len(rows), 1), -1)], 1), ids[:, 1:])
    for i in np.flatnonzero(lengths > LONG_WORD):
        ids = by_heap(words[i], ranks)
        counts[i], out[starts[i] : starts[i] + len(ids)] = len(ids), ids
    return out[out >= 0], counts


def encoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", to: str = "ids", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df with a column of token ids for each text; each match of the pattern is encoded by itself. A column of that name is replaced."""
    guarded(df.columns, [text], "encoded")
    df = df.drop(to)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    position = df.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in by_bytes(batches, position, batch_bytes):
            for rows, index, offsets, parts in distinct_parts(batch.column(position)):
                seen: dict[str, int] = {}
                split = [find(p) for p in parts]
                words = np.array([seen.setdefault(w, len(seen)) for x in split for w in x], np.int64)
                ids, n = all_merged([w.encode() for w in seen], ranks)
                per_part = np.fromiter(map(len, split), np.int64, len(split))
                used = expanded(index, np.cumsum(per_part) - per_part, per_part)
                used = words[used] if len(used) else used
                tokens = ids[expanded(used, np.cumsum(n) - n, n)] if len(ids) else ids
                by_word = np.concatenate([[0], np.cumsum(n[used] if len(used) else used)])
                by_part = np.concatenate([[0], np.cumsum(per_part[index] if len(index) else index)])
                lists = pa.ListArray.from_arrays(pa.array(by_word[by_part[offsets]], pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, lists], names=[*map(str, range(len(batch.columns))), to])

    return df.toDF(*map(str, range(len(df.columns)))).mapInArrow(encode, T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(df.schema.fields)] + schema.fields[-1:])).toDF(*df.columns, to)


def little_endian(ids: Column) -> Column:
    """The ids as bytes, four each, the lowest first."""
    table = literal_strings([i.to_bytes(2, "little").hex() + "0000" for i in range(1 << 16)])
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that the ids stand for: their binary pieces, concatenated. (Joined as hex, which takes linear time.)"""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal_strings(pieces), i)), ""))
