"""Distances of sources: against plain counting, with small chunks and bounds so that every path is taken."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pytest

from labframe.llm import divergence
from labframe.llm.common import stored

from .conftest import prose

ROWS = [(lang, f"s{s}", prose(100 * s + i, 40) if lang != "de" else "Straße  STRASSE, x1y 'é'") for lang in ("en", "fr", "de", None) for s in range(5) for i in range(8) if lang or s < 2]
ROWS += [("en", "none", None), ("en", "", "123 !! 9"), ("en", None, "thaned only"), ("solo", "s1", prose(1, 50)), ("ärm", "z", ""), ("ärm", "ä", "x")]


def plain(rows, least, top):
    texts = defaultdict(list)
    for lang, source, text in rows:
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        texts[lang or "", source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
    out = []
    for lang in {k[0] for k in texts}:
        groups = {s: Counter(w for t in ts for w in t) for (x, s), ts in texts.items() if x == lang}
        docs = Counter(w for (x, _), ts in texts.items() if x == lang for t in ts for w in set(t))
        kept = sorted(w for w, n in docs.items() if n >= least)
        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        pairs = defaultdict(list)
        for a, b in permutations(groups, 2):
            pairs[a].append((-sum(abs(p[a][w] - p[b][w]) for w in kept), b.encode()))
        for a in groups:
            out += [(lang, a, "pair", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(pairs[a]))]
            terms = sorted((q[w] - p[a][w], w.encode()) for w in kept if groups[a][w] and p[a][w] > q[w])
            out += [(lang, a, "term", i.decode(), -v, r + 1) for r, (v, i) in enumerate(terms[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(i, *r, 7, "x", 1) for i, r in enumerate(ROWS)], "doc_id bigint, lang string, source string, text string, n bigint, term string, word bigint").repartition(3)


@pytest.mark.parametrize("chunk", [64, 2, 1])
def test_all_distances_and_terms(groups, chunk):
    got = sorted(map(tuple, divergence.divergence(groups, least=6, top=7, chunk=chunk).collect()))
    assert got == plain(ROWS, 6, 7) and {r[2] for r in got} == {"pair", "term"}


def test_empty_tables_repeats_and_words_that_are_not_kept(groups):
    assert divergence.divergence(groups.where("doc_id < 0")).count() == 0
    twice = groups.unionByName(groups)
    assert sorted(map(tuple, divergence.divergence(twice, least=12, top=7).collect())) == plain(ROWS * 2, 12, 7)
    none = divergence.divergence(groups, least=10**6).collect()
    assert none and {(r.part, r.value) for r in none} == {("pair", 0)}


def test_pairs_are_anded_in_steps(groups, monkeypatch):
    """The work of a range in many steps gives the same sums."""
    rows = pd.DataFrame({"source": ["a"] * 40 + ["b"] * 40, "word": list(range(10)) * 8, "n": [1 + i // 10 for i in range(40)] * 2, "bits": [1 << (i // 10) | (1 << 60) for i in range(40)] + [3 << (i // 10) for i in range(40)]})
    heads = pd.DataFrame({"source": ["a", "b", "c"], "word": -1, "n": 0, "bits": 0, "total": [500, 700, 0], "kept": 640, "chunk": 0})
    frame = pd.concat([rows, heads]).fillna({"total": 0, "kept": 0, "chunk": 0}).assign(lang="x", ca=0, cb=0).astype({"total": int, "kept": int})
    whole = divergence.distances(frame)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    assert whole.equals(divergence.distances(frame)) and len(whole) == 3


def test_terms_of_slices_and_large_counts():
    texts = pa.array(["skipped", "Abc dE", None, "", "é-É1x", "end"])[1:]
    row, terms = divergence.terms_of(texts)
    assert [(r, t.decode()) for r, t in zip(row.tolist(), terms.to_pylist(), strict=True)] == [(0, "abc"), (0, "de"), (3, "é"), (3, "É"), (3, "x"), (4, "end")]
    n = [0, 3, 10**12]
    got = divergence.shares(pd.Series(n).to_numpy(), pd.Series([2 * 10**12] * 3).to_numpy(), pd.Series([4] * 3).to_numpy())
    assert got.tolist() == [1 + 10**9 * (x + 5) // (2 * 10**12 + 20) for x in n]


def test_words_hold_terms_of_one_language(spark):
    kept = stored(spark.createDataFrame([(l, f"t{i}", i % 7) for l in "abc" for i in range(150)], "lang string, term string, total bigint"), "kept")
    rows = divergence.numbered(kept).collect()
    assert len({(r.word, r.bit) for r in rows}) == len(rows) == 450
    langs = defaultdict(set)
    for r in rows:
        langs[r.word].add(r.lang)
    assert all(len(x) == 1 for x in langs.values()) and all(0 <= r.bit < 64 for r in rows)
