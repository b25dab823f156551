"""Vector codes against plain assignment in Python numbers, and the trees against their own definition."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from labframe.llm import vector_codes as vc


def table(n, length, seed, spread=0.4):
    r = random.Random(seed)
    heart = [[r.gauss(0, spread) for _ in range(length)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.05) for c in r.choice(heart)], r.choice([None, 1, 2])) for i in range(n)]


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(np.float64(c) * 4096)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    w = vc.widths(len(kept[0][1]), parts) if kept else [0] * parts
    ends = np.cumsum([0, *w])
    cut = lambda v: [v[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])):
        first.setdefault(i, v)
    books = [list(b) for b in zip(*(cut(v) for v in list(first.values())[:entries]), strict=True)] or [[] for _ in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda v: [min(range(len(b)), key=lambda e: (far(p, b[e]), e)) for p, b in zip(cut(v), books, strict=True)]
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p, e in enumerate(code(v)):
                held[p, e].append(cut(v)[p])
        for (p, e), found in held.items():
            books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = []
    for i, v, label in kept:
        e = code(v)
        out.append((i, "".join(f"{x:02x}" for x in e), sum(far(p, books[k][x]) for k, (p, x) in enumerate(zip(cut(v), e, strict=True))), label))
    sums = defaultdict(int)
    for r in out:
        sums[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=repr)


DDL = "vec_id bigint, embedding array<double>, label int, part int, id string"


def coded(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL).repartition(3)
    return sorted(map(tuple, vc.vector_codes(df, **kw).collect()), key=repr)


def test_codes_of_a_table_with_faulty_vectors(spark):
    rows = table(400, 16, 1)
    rows += [(500, None, 1), (501, [None] + [0.1] * 15, 1), (502, [float("nan")] + [0.1] * 15, 2), (-3, [float("inf")] + [0.0] * 15, 2), (503, [0.25] * 16, 3), (504, [0.25] * 16, None), (505, [-0.0001] * 16, None)]
    assert coded(spark, rows, block=64) == plain(rows)


@pytest.mark.parametrize("case", ["ties", "few", "repeats", "uneven", "large", "same", "no_components", "nulls"])
def test_edge_cases(spark, case):
    rows = {
        "ties": [(i, [(-1) ** (i // (k + 1)) * 0.5 for k in range(8)], i % 2) for i in range(80)],
        "few": table(5, 8, 2),
        "repeats": table(60, 8, 3) * 2 + [(3, [0.0] * 8, 1), (None, [9.0] * 8, 1)],
        "uneven": table(90, 11, 4),
        "large": [(i, [float((i * 7919 + k * 104729) % 1000) * 100 for k in range(8)], 1) for i in range(60)],
        "same": [(i, [0.125] * 8, None) for i in range(300)],
        "no_components": [(i, [], 1) for i in range(3)],
        "nulls": [(1, None, 1)],
    }[case]
    assert coded(spark, rows, block=32) == plain(rows)


def test_lengths_and_sizes(spark):
    rows = table(50, 8, 5)
    assert coded(spark, [*rows, (60, [0.5] * 9, 1)]) == plain(rows)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [*rows, (61, [1e20] * 8, 1)])
    assert coded(spark, []) == []


@pytest.mark.parametrize("kind", ["spread", "clusters", "line", "copies"])
def test_trees_hold_all_points_and_their_sums(kind):
    r = np.random.default_rng(6)
    x = {"spread": r.integers(-4000, 4000, (8, 700, 6)), "clusters": r.integers(-5, 5, (8, 700, 6)) + 1000 * r.integers(0, 4, (8, 700, 1)), "line": np.arange(700)[None, :, None] * np.ones((8, 1, 6), np.int64), "copies": np.repeat(r.integers(-9, 9, (8, 7, 6)), 100, 1)}[kind]
    trees = vc.planted(x)
    part_of = np.repeat(np.arange(8), np.diff(np.append(trees["roots"], len(trees["spans"]))))
    assert all(sorted(o) == list(range(700)) for o in trees["order"].tolist())
    for b, (first, end) in enumerate(trees["spans"]):
        points = x[part_of[b]][trees["order"][part_of[b]][first:end]]
        assert (points.sum(0) == trees["sums"][b]).all()
        assert np.sqrt(((points - points.mean(0)) ** 2).sum(1)).max() <= trees["radii"][b] * (1 + 1e-9) + 1e-9
        kids = trees["below"][b]
        if kids[0] >= 0:
            assert [trees["spans"][kids[0]][0], trees["spans"][kids[1]][1]] == [first, end] and trees["spans"][kids[0]][1] == trees["spans"][kids[1]][0]
    books = x[:, r.permutation(700)[:16]]
    codes = vc.block_codes(trees, x, books, np.ones((8, 16), bool))
    d = ((x[:, :, None] - books[:, None]) ** 2).sum(-1)
    assert (codes == d.argmin(2)).all()
    counts, sums = vc.block_sums(trees, x, books, np.ones((8, 16), bool))
    for p in range(8):
        assert counts[p].tolist() == np.bincount(codes[p], minlength=16).tolist()
        assert all((sums[p, e] == x[p][codes[p] == e].sum(0)).all() for e in range(16))


def test_clusters_are_owned_by_balls_not_points():
    """Where the data have clusters, whole balls go to an entry and few points are compared."""
    r = np.random.default_rng(7)
    heart = r.integers(-4000, 4000, (8, 12, 6))
    x = heart[:, r.integers(0, 12, 1000)] + r.integers(-30, 30, (8, 1000, 6))
    books = heart[:, np.arange(16) % 12] + np.where(np.arange(16) < 12, 0, 9000)[:, None]
    trees = vc.planted(x)
    balls, _, (part, _, _) = vc.owned(trees, x, books, np.ones((8, 16), bool))
    assert len(part) < 0.05 * x.shape[0] * x.shape[1] and len(balls) < 0.2 * x.shape[0] * x.shape[1]
