"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word comes in as its own vector, if the training rows hold it often enough, beside the vectors of its character
n-grams, so inflected and unseen forms of a stem are recognised. Two gated recurrent layers, one each way, read a
window of words, attention pools their states, and a logistic unit gives the window's probability. Windows overlap
and cover the whole text; a text scores as its highest window. Labels are of whole texts, so training first
takes every window for its text's label and then, text by text, the window that scores highest.

Training rows are a bounded sample: the first SAMPLE keys of each class in the order of a hash of the key, texts up
to SAMPLE_BYTES bytes; a key with several labels counts as toxic if one says so, one with several texts has the least. Every row is scored, whatever its length; features come from the text alone.

Defined results: null, empty and blank texts have one window of one empty word, which no label has taught to be toxic; repeated rows score alike; further columns are ignored, also ones named as the results; an empty table gives
an empty table. Without labels of both classes there is nothing to learn, and an error says so.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import by_bytes, guarded

#: Bounds of the training sample: rows of each class, and bytes of a text.
SAMPLE, SAMPLE_BYTES = {1: 1500, 0: 2500}, 12_000
#: Words in a window and between the starts of windows.
WINDOW, STRIDE = 32, 16
#: Sizes: states each way, word vector, n-gram vector, n-gram buckets, texts a word must be in.
HIDDEN, WORD, CHAR, BUCKETS, MIN_TEXTS = 8, 12, 12, 1 << 15, 3
#: Bytes of text scored together, and windows.
BATCH_BYTES, BATCH_WINDOWS = 8_000_000, 2048
EDGES = ".,;:!?\"'()[]{}<>*&%$#@_-+=/\\|~^`"


@dataclass
class Model:
    vocabulary: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)


def begun(vocabulary: list[str], seed: int = 7) -> Model:
    r, inputs = np.random.default_rng(seed), WORD + CHAR
    draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"word": r.normal(0, 0.1, (len(vocabulary) + 1, WORD)).astype(np.float32), "char": r.normal(0, 0.1, (BUCKETS, CHAR)).astype(np.float32)}
    for way in "fb":
        p |= {f"W{way}": draw(inputs, 3 * HIDDEN), f"U{way}": draw(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"a": draw(2 * HIDDEN, 1)[:, 0], "w": draw(2 * HIDDEN, 1)[:, 0], "b": np.full(1, -1.0, np.float32)}
    p["word"][0] = 0
    return Model(vocabulary, p)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word of each place, offsets by text, distinct words): white space splits, edge punctuation and case go."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), offsets - offsets[0], pc.utf8_trim(pc.utf8_lower(words.dictionary), EDGES)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of 3 to 5 bytes of `<word>`, number of them by word); equal work for all words at once."""
    part = lambda x: pa.scalar(x, pa.large_string())
    raw = pc.binary_join_element_wise(part("<"), words.cast(pa.large_string()), part(">"), part("")).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the end of the word
    key, found, at = data.copy(), [], []
    for n in range(2, 6):
        key = key[: len(data) - n + 1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n > 2:
            fits = np.flatnonzero(left[: len(key)] >= n)
            found.append((key[fits] * np.uint32(2654435761) >> np.uint32(17)) % BUCKETS)
            at.append(fits)
    found, at = np.concatenate(found), np.concatenate(at)
    of = np.searchsorted(offsets, at, "right") - 1
    order = np.argsort(of, kind="stable")
    return found[order].astype(np.int64), np.bincount(of, minlength=len(words))


def inputs(model: Model, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of words, their rows in `word`, n-gram buckets, n-gram counts)."""
    known = pc.fill_null(pc.index_in(words, value_set=pa.array(model.vocabulary, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    found, counts = grams(words)
    sums = np.zeros((len(words), CHAR), np.float32)
    starts = np.cumsum(counts) - counts
    for lo in range(0, len(words), 20_000):  # bounded memory
        hi = min(lo + 20_000, len(words))
        some = np.flatnonzero(counts[lo:hi]) + lo
        if len(some):
            block = model.p["char"][found[starts[lo] : starts[hi - 1] + counts[hi - 1]]]
            sums[some] = np.add.reduceat(block, starts[some] - starts[lo])
    sums /= np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)
    return np.concatenate([model.p["word"][known], sums], 1), known, found, counts


def windows(index: np.ndarray, offsets: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each place of each window, row of the window); places past the text hold `none`."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    start = (offsets[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))).astype(np.int32)
    at, end = start[:, None] + np.arange(WINDOW, dtype=np.int32), offsets[row + 1].astype(np.int32)
    return np.where(at < end[:, None], np.append(index, none).astype(np.int32)[np.minimum(at, len(index))], np.int32(none)), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def one_way(x: np.ndarray, at: np.ndarray, there: np.ndarray, u: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """States of one layer, x being the words' inputs times its weights; `keep` gets what the way back needs."""
    h, out = np.zeros((len(at), HIDDEN), np.float32), np.empty((WINDOW, len(at), HIDDEN), np.float32)
    for t in order:
        xt, hu = x[at[:, t]], h @ u
        gates = sigmoid(xt[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(xt[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = there[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, new, hu[:, 2 * HIDDEN :], m))
        h = new + z * (h - new) if m.all() else np.where(m, new + z * (h - new), h)
        out[t] = h
    return out


def forward(model: Model, x: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window; x: vectors of words and, last, of the place past the text."""
    p, there = model.p, at != len(x) - 1
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    states = np.concatenate([one_way(x @ p[f"W{w}"] + p[f"c{w}"], at, there, p[f"U{w}"], order, kept[w]) for w, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))], 2)
    e = np.where(there.T, states @ p["a"], -1e9)
    e = np.exp(e - e.max(0))
    e *= there.T
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    if keep is not None:
        keep |= kept | {"states": states, "alpha": alpha, "pooled": pooled, "there": there}
    return pooled @ p["w"] + p["b"][0]


def gradients(model: Model, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean log loss by all parameters but the vectors, and by x."""
    p, keep = model.p, {}
    d = ((sigmoid(forward(model, x, at, keep)) - y) * weight / len(y)).astype(np.float32)
    states, alpha = keep["states"], keep["alpha"]
    g = {"w": keep["pooled"].T @ d, "b": d.sum(keepdims=True)}
    dpool = d[:, None] * p["w"]
    dalpha = np.einsum("bh,tbh->tb", dpool, states)
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["a"] = np.einsum("tb,tbh->h", de, states)
    dstates = alpha[:, :, None] * dpool + de[:, :, None] * p["a"]
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        u, dh = p[f"U{way}"], np.zeros((len(at), HIDDEN), np.float32)
        g |= {f"U{way}": np.zeros_like(u), f"W{way}": np.zeros_like(p[f"W{way}"]), f"c{way}": np.zeros_like(p[f"c{way}"])}
        for t, h, z, r, new, hn, m in reversed(keep[way]):
            dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            live = dh * m
            dnew, dz = live * (1 - z) * (1 - new * new), live * (h - new) * z * (1 - z)
            dr = dnew * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dnew * r], 1)
            g[f"U{way}"] += h.T @ dhu
            dh = live * z + dhu @ u.T + dh * ~m
            dxt = np.concatenate([dz, dr, dnew], 1)
            g[f"W{way}"] += x[at[:, t]].T @ dxt
            g[f"c{way}"] += dxt.sum(0)
            np.add.at(dx, at[:, t], dxt @ p[f"W{way}"].T)
    return g, dx


def trained(texts: list[str], labels: list[int], noisy: int = 2, chosen: int = 5, rate: float = 0.01, seed: int = 7) -> Model:
    """A model of the given rows; the same rows in the same order give the same model."""
    index, offsets, words = tokens(pa.array(texts, pa.string()))
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        raise ValueError("toxicity: the training rows need labels of both classes")
    plain = words.to_pylist()
    seen: Counter = Counter()
    for i in range(len(texts)):
        seen.update({plain[k] for k in set(index[offsets[i] : offsets[i + 1]].tolist())})
    model = begun(sorted(w for w, n in seen.items() if n >= MIN_TEXTS and w), seed)
    at, row = windows(index, offsets, len(words))
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    _, known, found, counts = inputs(model, words)
    starts = np.cumsum(counts) - counts
    r, moments = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    steps = 0

    def vectors(local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = counts[local]
        places = np.repeat(starts[local] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = np.zeros((len(local) + 1, WORD + CHAR), np.float32)
        x[:-1, :WORD] = model.p["word"][known[local]]
        some = np.flatnonzero(n)
        if len(some):
            x[some, WORD:] = np.add.reduceat(model.p["char"][found[places]], (np.cumsum(n) - n)[some])
        x[:-1, WORD:] /= np.sqrt(np.maximum(n, 1))[:, None]
        return x, found[places], n

    def local_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        local, inverse = np.unique(at[w], return_inverse=True)
        inverse = inverse.reshape(-1, WINDOW)
        if local[-1] == len(words):
            return local[:-1], inverse
        return local, inverse

    for epoch in range(noisy + chosen):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), 48):
            batch = order[lo : lo + 48]
            if epoch < noisy:
                w = np.concatenate([r.choice(np.arange(first[i], first[i + 1]), min(6, first[i + 1] - first[i]), replace=False) for i in batch])
            else:
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
                local, inside = local_of(own)
                score = forward(model, vectors(local)[0], inside)
                bounds = np.cumsum([0, *(first[i + 1] - first[i] for i in batch)])
                tops = [np.argsort(-score[a:b])[: 1 if y[i] else 2] + a for i, a, b in zip(batch, bounds[:-1], bounds[1:], strict=True)]
                w = own[np.concatenate(tops)]
            local, inside = local_of(w)
            x, buckets, n = vectors(local)
            g, dx = gradients(model, x, inside, y[row[w]], weight[row[w]])
            dx = dx[:-1]
            chars = np.repeat(dx[:, WORD:] / np.sqrt(np.maximum(n, 1))[:, None], n, 0)
            steps += 1
            for k, (rows, grad) in {"word": (known[local], dx[:, :WORD]), "char": (buckets, chars)}.items():
                unique, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(unique), grad.shape[1]), np.float32)
                np.add.at(total, inverse, grad)
                if k == "word":
                    total[unique == 0] = 0
                moments[k][1][unique] += total * total
                model.p[k][unique] -= 5 * rate * total / (np.sqrt(moments[k][1][unique]) + 1e-6)
            norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))) / 2)
            for k, v in g.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * v / norm
                s *= 0.99
                s += 0.01 * (v / norm) ** 2
                model.p[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Score of each text: its highest window's probability."""
    index, offsets, words = tokens(texts)
    x = np.concatenate([inputs(model, words)[0], np.zeros((1, WORD + CHAR), np.float32)])
    at, row = windows(index, offsets, len(words))
    logits = np.empty(len(at), np.float32)
    for lo in range(0, len(at), BATCH_WINDOWS):
        local, inside = np.unique(at[lo : lo + BATCH_WINDOWS], return_inverse=True)
        own = x[local] if local[-1] == len(words) else np.concatenate([x[local], x[-1:]])
        logits[lo : lo + BATCH_WINDOWS] = forward(model, own, inside.reshape(-1, WINDOW))
    return sigmoid(np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(row, np.arange(len(texts))))) if len(texts) else np.zeros(0)


def fold(key: Column) -> Column:
    """0, 1 or 2: crc32 of the key as text, modulo 3. Rows of fold 1 are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def fitted(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] | None = None) -> Model:
    """Trains on a bounded sample of the labelled rows outside fold 1 (see SAMPLE), in one task; the driver gets the model alone."""
    few = labels.where((fold(F.col(id_column)) != 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    few = [few.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(n) for y, n in (sample or SAMPLE).items()]
    rows = df.select(F.col(id_column).alias("key"), F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).join(F.broadcast(few[0].unionByName(few[1])), "key")
    rows = rows.groupBy("key").agg(F.max("y").alias("y"), F.min("t").alias("t"))  # repeated keys give one row

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if len({y for _, y, _ in some}) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained([t for *_, t in some], [y for _, y, _ in some]))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(train, "model binary").collect()  # at most the sample's rows, each of bounded size
    if not found:
        raise ValueError("toxicity: the training rows need labels of both classes")
    return pickle.loads(found[0].model)


def scored(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for each row of df."""
    guarded(df.columns, [id_column, text], "toxicity")
    shipped, kind = df.sparkSession.sparkContext.broadcast(model), df.schema[id_column].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores(shipped.value, batch.column("text")))], ["id", "score"])

    out = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_column), (fold(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of df that score below the threshold, with all their columns."""
    shipped, position = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, position, BATCH_BYTES):
            yield batch.filter(pa.array(scores(shipped.value, batch.column(position)) < threshold))

    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return named.mapInArrow(keep, named.schema).toDF(*df.columns)
