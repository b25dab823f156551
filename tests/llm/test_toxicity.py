import os
import random

import numpy as np
import pyarrow as pa
import pytest

from labframe.llm import toxicity

from .conftest import WORDS, corpus


def labelled(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        words, bad = [r.choice(WORDS) for _ in range(r.randrange(5, 150))], i % 3 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = "vequ" + r.choice(WORDS) if r.random() < 0.5 else "scum"
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = labelled(400, 1)
    return toxicity.trained([t for _, t, _ in rows], [y for _, _, y in rows])


def test_held_out_rows_with_unseen_forms(model):
    rows = labelled(300, 2)
    s, y = toxicity.scores(model, pa.array([t for _, t, _ in rows])), np.array([y for *_, y in rows])
    assert ((s >= 0.7) == y).mean() > 0.95


def test_gradients_are_the_differences():
    model = toxicity.begun(["ab", "cd"], 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(7, toxicity.WORD + toxicity.CHAR)), np.zeros((1, toxicity.WORD + toxicity.CHAR))])
    at = r.integers(0, 7, (5, toxicity.WINDOW))
    at[2, 9:] = at[4, 1:] = 7
    y, w = np.array([1, 0, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = toxicity.forward(model, x, at)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g, dx = toxicity.gradients(model, x, at, y, w)
    for k, grad in [*g.items(), ("x", dx)]:
        target = x if k == "x" else model.p[k]
        for i in r.choice(target.size - (toxicity.WORD + toxicity.CHAR if k == "x" else 0), 4):
            old = target.flat[i]
            target.flat[i] = old + 1e-2
            up = loss()
            target.flat[i] = old - 1e-2
            down = loss()
            target.flat[i] = old
            assert abs((up - down) / 2e-2 - grad.flat[i]) < 2e-3 + 0.05 * abs(grad.flat[i]), k


def test_windows_overlap_and_cover():
    n = [0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500]
    offsets = np.cumsum([0, *n])
    at, row = toxicity.windows(np.arange(offsets[-1]), offsets, -1)
    for i, m in enumerate(n):
        mine = at[row == i]
        assert set(mine[mine >= 0]) == set(range(offsets[i], offsets[i] + m))
        assert all(set(a) & set(b) - {-1} for a, b in zip(mine, mine[1:]))


def test_scores_do_not_depend_on_the_batch(model):
    texts = [t for _, t in corpus()]
    whole = toxicity.scores(model, pa.array(texts, pa.string()))
    assert np.allclose(whole, [toxicity.scores(model, pa.array([t], pa.string()))[0] for t in texts], atol=1e-5)
    assert whole[0] == whole[1] == whole[2] and (whole[:3] < 0.7).all()


def test_scores_are_those_of_a_plain_loop(model):
    """Word by word, state by state, with plain numbers."""
    import math

    p, h = {k: v.astype(float) for k, v in model.p.items()}, toxicity.HIDDEN

    def vector(word):
        raw = f"<{word}>".encode()
        buckets = []
        for i in range(len(raw)):
            key = raw[i]
            for n in range(2, 6):
                if i + n <= len(raw):
                    key = (key * 0x01000193 & 0xFFFFFFFF) ^ raw[i + n - 1]
                    if n > 2:
                        buckets.append(((key * 2654435761 & 0xFFFFFFFF) >> 17) % toxicity.BUCKETS)
        at = model.vocabulary.index(word) + 1 if word in model.vocabulary else 0
        grams = [sum(p["char"][b][j] for b in buckets) / math.sqrt(max(len(buckets), 1)) for j in range(toxicity.CHAR)]
        return [*p["word"][at], *grams]

    logistic = lambda x: 1 / (1 + math.exp(-x))

    def layer(xs, way):
        state, out = [0.0] * h, []
        for x in xs:
            wx = [sum(x[i] * p[f"W{way}"][i][j] for i in range(len(x))) + p[f"c{way}"][j] for j in range(3 * h)]
            uh = [sum(state[i] * p[f"U{way}"][i][j] for i in range(h)) for j in range(3 * h)]
            z, r = ([logistic(wx[k * h + j] + uh[k * h + j]) for j in range(h)] for k in (0, 1))
            new = [math.tanh(wx[2 * h + j] + r[j] * uh[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            out.append(state)
        return out

    def window(words):
        xs = [vector(w) for w in words]
        both = [[*f, *b] for f, b in zip(layer(xs, "f"), layer(xs[::-1], "b")[::-1], strict=True)]
        e = [math.exp(sum(s * a for s, a in zip(x, p["a"], strict=True))) for x in both]
        pooled = [sum(e[t] * both[t][j] for t in range(len(both))) / sum(e) for j in range(2 * h)] if both else [0.0] * 2 * h
        return sum(a * b for a, b in zip(pooled, p["w"], strict=True)) + p["b"][0]

    texts = [t for _, t, _ in labelled(12, 9)] + ["", "scum", "Scum! (vequths)"]
    for text, got in zip(texts, toxicity.scores(model, pa.array(texts)), strict=True):
        words = [w.lower().strip(toxicity.EDGES) for w in text.split() or [""]]
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        assert abs(got - logistic(max(window(words[i : i + toxicity.WINDOW]) for i in starts))) < 1e-4, text


def test_repeated_keys_and_labels_give_one_training_row(spark):
    rows = labelled(120, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    a, b = toxicity.fitted(docs, labels), toxicity.fitted(docs.unionByName(docs), labels.unionByName(labels))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_tables(spark, docs, none, twice, model):
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.scored(none, model).count() == 0 and toxicity.scored(twice, model).count() == 2 * len(corpus()) + 1
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_fitting_uses_no_row_of_the_held_out_fold(spark):
    rows = labelled(240, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    held = labels.where(toxicity.fold(labels.doc_id) == 1)
    a = toxicity.fitted(docs, labels)
    b = toxicity.fitted(docs.join(held, "doc_id", "left_anti"), labels)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    with pytest.raises(ValueError):
        toxicity.fitted(docs, labels.where("toxic = 0"))


def test_training_is_a_task_and_not_the_drivers(spark, monkeypatch):
    rows = labelled(120, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    used = docs.join(labels, "doc_id").where(toxicity.fold(docs.doc_id) != 1).orderBy("doc_id").collect()
    train, driver = toxicity.trained, os.getpid()
    own = train([r.text for r in used], [r.toxic for r in used])
    monkeypatch.setattr(toxicity, "trained", lambda *a: pytest.fail("trained in the driver") if os.getpid() == driver else train(*a))
    model = toxicity.fitted(docs, labels)
    assert model.vocabulary == own.vocabulary and all(np.allclose(model.p[k], own.p[k], atol=1e-5) for k in own.p)
