import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labframe.llm import common, near_dup, substring_dedup

from .conftest import corpus, edited, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t, k):
    w = WORD.findall(low(t))
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(sets, similarity=80):
    """Component of each node by comparing all pairs."""
    names = list(sets)
    least = {n: n for n in names}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {n: find(n) for n in names}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_the_brute_force_ones(docs, k):
    sets = {i: shingles(t, k) for i, t in corpus()}
    want = brute(sets)
    got = near_dup.near_duplicates(docs, shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_no_rows_and_repeated_rows(none, twice):
    assert near_dup.near_duplicates(none).count() == 0
    got = near_dup.near_duplicates(twice, shingle=2).collect()
    assert len(got) == 2 * len(corpus()) + 1


def test_a_group_around_the_threshold_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    base = prose(5, 150)
    rows = [(i, edited(base, i, i % 25)) for i in range(140)]
    want = brute({i: shingles(t, 2) for i, t in rows})
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 10


@pytest.mark.parametrize("wide", [0, 2])
def test_wide_buckets_meet_by_rare_shingles(spark, monkeypatch, wide):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "WIDE", wide)
    shared = prose(6, 100)  # of all texts, which are below the threshold by their own words but for some
    rows = [(i, f"{shared} {prose(1000 + i // 2 if i % 10 < 2 else 2000 + i, 60)} {'end' * (i % 2)}") for i in range(120)]
    want = brute({i: shingles(t, 2) for i, t in rows})
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) == 108


@pytest.mark.parametrize("wide", [0, 1])
def test_buckets_of_rare_shingles_that_are_wide_are_split_again(spark, monkeypatch, wide):
    """Sets around the threshold whose own shingles are those of many others."""
    r, split = random.Random(4), []
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "WIDE", wide)
    second = near_dup.second_meetings
    monkeypatch.setattr(near_dup, "second_meetings", lambda *a: split.append(1) or second(*a))
    shared, fields = prose(6, 90).split(" "), [f"{a}{b}" for a in "abcdefgh" for b in range(3)]
    rows = [(i, " ".join([*shared, *(f"{k}:{r.choice(fields[:4])} {k}" for k in range(14))])) for i in range(150)]
    want = brute({i: shingles(t, 2) for i, t in rows})
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert {x.doc_id: x.component_id for x in got} == want and split and 10 < len(set(want.values())) < 150


def test_a_centre_of_very_many_members(spark):
    """One text and thousands that differ from it in a word: its set goes to each block of them, not to each."""
    base = prose(7, 60).split(" ")
    rows = [(i, " ".join([*base[:30], f"w{i}", *base[31:]])) for i in range(20_000)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), shingle=2)
    assert got.where("component_id <> 0").count() == 0 and got.where("kept").count() == 1


def test_recall_of_the_tensored_tables_at_the_threshold():
    scheme, r, met = near_dup.TENSORED, np.random.default_rng(3), 0
    for _ in range(300):
        values = r.integers(0, 2**63, 100, np.int64).astype(np.uint64)  # 80 of 100 shared
        pair = [np.sort(values[:90]), np.sort(values[np.r_[0:80, 90:100]])]
        flat, offsets = np.concatenate(pair), np.array([0, 90, 180])
        b = near_dup.bands(near_dup.minhashes(flat, offsets, scheme.hashes), scheme)
        same = b[0] == b[1]
        met += same[: scheme.a_bands].any() and same[scheme.a_bands :].any()
    assert met >= 297


def test_shingle_sets_do_not_depend_on_the_batch():
    texts = [t and low(t) for _, t in corpus()]
    whole = near_dup.sets(pa.array(texts, pa.string()), 2)
    for i, t in enumerate(texts):
        own = near_dup.sets(pa.array([t], pa.string()), 2)[0]
        assert own.tolist() == whole[0][whole[1][i] : whole[1][i + 1]].tolist()


def test_words_of_slices_are_those_of_the_texts():
    texts = [None, "", "Ä B c", *(prose(900 + i, 30 + i).upper() + " straße\tÉ\n x" for i in range(40))]
    whole = pa.array(texts, pa.string())
    for lo, n in ((0, 43), (5, 20), (17, 26), (42, 1)):
        h, offsets = near_dup.words_of(whole.slice(lo, n))
        for i in range(n):
            own = near_dup.words_of(pa.array([low(texts[lo + i])]))[0]
            assert len(own) == len(WORD.findall(low(texts[lo + i]))) and h[offsets[i] : offsets[i + 1]].tolist() == own.tolist()


def test_paragraphs_that_repeat(spark):
    shared, other = prose(1, 60), prose(2, 80)
    rows = [(1, f"{prose(11, 70)}\n{shared}\n{prose(12, 55)}"), (2, f"short line\n{shared}"), (3, f"{edited(shared, 1, 1)}\nshort line"), (4, other), (5, other), (6, None), (7, ""), (8, prose(13, 400)), (9, f"{prose(14, 60)}\n{prose(15, 60)}\n{shared}\n{shared}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, origins string")
    lines = {(i, k): shingles(line, 5) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 50}
    want = defaultdict(list)
    for node, root in brute(lines).items():
        if node != root:
            want[node[0]].append(node[1])
    got = {r.doc_id: r for r in substring_dedup.repeated(df).collect()}
    assert {i: sorted(r.removed) for i, r in got.items()} == {i: sorted(want[i]) for i, _ in rows}
    assert {i: v for i, v in want.items() if v} == {2: [1], 3: [0], 5: [0], 9: [2, 3]} and got[9].origins == [1] and got[1].n_repeated == 1
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(df, substring_dedup.repeated(df)).collect()}
    assert kept[2] == "short line" and kept[5] == "" and kept[4] == other and kept[6] is None
    assert substring_dedup.repeated(df.where("doc_id < 0")).count() == 0


def test_tuned_bands():
    scheme = substring_dedup.tuned(0.8)
    assert (1 - 0.8**scheme.a_rows) ** scheme.a_bands <= 3e-4 and scheme.hashes <= 64


def windows(t, n=50):
    w = WORD.findall(low(t))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_passages_over_lines_and_inside_longer_lines(spark):
    lines, inner = [prose(30 + i, 20) for i in range(4)], prose(40, 60)
    block = "\n".join(lines)
    rows = [(1, f"{prose(41, 30)}\n{block}\n{prose(42, 30)}"), (2, f"{prose(43, 10)}\n{block}\nend of it"), (3, f"{prose(44, 90)} {inner} {prose(45, 90)}"), (4, f"{prose(46, 200)} {inner} {prose(47, 100)}"), (5, "no copy " + prose(48, 60)), (None, f"{prose(49, 70)} {inner}"), (None, f"{prose(50, 70)} {inner}"), (6, None), (7, ""), (8, prose(51, 49)), (9, prose(51, 49)), (10, f"{prose(52, 55)} {prose(52, 55)}")]
    rows += [rows[3], (4, f"{inner} other text of the same key")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marked = substring_dedup.repeated(df)
    got = {r.doc_id: (r.removed, r.cuts, r.origins) for r in marked.collect()}
    assert (got[1], got[2], got[3][1:]) == (([], [], []), ([1, 2, 3, 4], [], [1]), ([(len(prose(44, 90)) + 1, len(prose(44, 90)) + 1 + len(inner))], []))
    texts = [r.text for r in substring_dedup.without_repeats(df, marked).collect()]
    assert len(texts) == len(rows)
    seen = defaultdict(int)
    for t in {t for t in texts if t}:
        for w in set(windows(t)):
            seen[w] += 1
    assert not [w for w, n in seen.items() if n > 1]
    assert sum(low(inner) in low(t or "") for t in texts) == 1 and sum(low(lines[0]) in low(t or "") for t in texts) == 1
    assert sorted(t for t in texts if t and len(t.split()) == 49) == sorted([rows[9][1], rows[10][1]])


def test_a_bucket_is_compared_if_its_centre_is_unlike_its_members(spark):
    # c is too short for a and b, but meets them in the only table and may be its centre
    scheme, rows, bases = near_dup.Scheme(1, 1), [], [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(40)]
    for k, base in enumerate(bases):
        rows += [(3 * k, base), (3 * k + 1, base + " one more"), (3 * k + 2, " ".join(base.split(" ")[:75]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes, found = near_dup.clustered(near_dup.stored(near_dup.signed(df, "doc_id", "text", 2, scheme), "signed"), df, "doc_id", "text", 2, 80, scheme)
    at = {r.id: (r.component or r.node, r.bands[0]) for r in nodes.join(found, "node", "left").collect()}
    met = [k for k in range(40) if at[3 * k][1] == at[3 * k + 1][1]]
    assert len(met) > 30 and all(at[3 * k][0] == at[3 * k + 1][0] != at[3 * k + 2][0] for k in met)


def test_rows_without_a_key_are_classed_by_text(spark, twice):
    want = brute({i: shingles(t, 2) for i, t in corpus()})
    got = near_dup.near_duplicates(twice, shingle=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, i == c) for i, c in want.items()} | {(None, 20, False)}
    texts = [prose(60, 80), prose(60, 80), edited(prose(60, 80), 1, 1), prose(61, 80), None]
    got = near_dup.near_duplicates(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string"), shingle=2).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 5


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    tables, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: tables.append(name) or stored(df, name))
    path = np.random.default_rng(1).permutation(5000).tolist()
    edges = [*zip(path[:-1], path[1:], strict=True), (6001, 6000), (6000, 6001), (6002, 6001), (7000, 7000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(5000)} | {6000: 6000, 6001: 6000, 6002: 6000}
    assert tables.count("labels") <= 20


def test_a_long_chain_of_revisions_is_one_group(spark):
    base = " ".join(f"w{i}" for i in range(140)).split(" ")
    chain = []
    for k in range(150):  # each differs from the one before in four words
        for j in range(4):
            base[(7 * k + j) % 140] = f"r{k}x{j}"
        chain.append(" ".join(base))
    got = near_dup.near_duplicates(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(chain)], "doc_id bigint, text string"), shingle=2).collect()
    want = brute({1000 + k: shingles(t, 2) for k, t in enumerate(chain)})
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 1


def test_runs_of_short_lines_are_paragraphs(spark):
    lines = [prose(70 + i, 15) for i in range(6)]
    near = [*lines[:5], edited(lines[5], 1, 1)]
    rows = [(1, "\n".join(lines) + "\n\n" + prose(80, 20)), (2, prose(81, 60) + "\n" + "\n".join(near) + "\n\n" + prose(82, 30)), (3, "\n\n".join(lines[:3]))]
    got = {r.doc_id: r for r in substring_dedup.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2].removed == [1, 2, 3, 4, 5, 6] and got[2].origins == [1] and got[1].removed == [] == got[3].removed


def test_repeats_of_a_table_are_those_of_all_comparisons(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    units, near, gone = {}, defaultdict(set), {}
    for i, t in texts.items():
        lines, run = [*t.split("\n"), ""], []
        for k, line in enumerate(lines):
            n = len(WORD.findall(line))
            if run and not 0 < n < 50:
                if sum(len(WORD.findall(lines[j])) for j in run) >= 50:
                    units[i, run[0], run[-1]] = shingles("\n".join(lines[j] for j in run), 5)
                run = []
            if n >= 50:
                units[i, k, k] = shingles(line, 5)
            elif n:
                run.append(k)
    for node, root in brute(units).items():
        if node != root:
            near[node[0]] |= set(range(node[1], node[2] + 1))
    seen = set()
    for i in sorted(texts):
        gone[i] = np.zeros(len(WORD.findall(texts[i])), bool)
        for k, w in enumerate(windows(texts[i])):
            if w in seen:
                gone[i][k : k + 50] = True
            seen.add(w)
    got = {r.doc_id: r for r in substring_dedup.repeated(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for i, t in texts.items():
        whole, cuts, at, word = set(), [], 0, 0
        for k, line in enumerate(t.split("\n")):
            spans = [m.span() for m in WORD.finditer(line)]
            own = gone[i][word : word + len(spans)]
            if len(own) and own.all():
                whole.add(k)
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(int), [0]])))
                cuts += [(at + spans[a][0], at + spans[b - 1][1]) for a, b in edge.reshape(-1, 2)]
            at, word = at + len(line) + 1, word + len(spans)
        assert (got[i].removed, [(c.low, c.high) for c in got[i].cuts]) == (sorted(near[i] | whole), cuts), i
    assert sum(map(len, near.values())) and any(g.any() for g in gone.values())


def short_paragraphs(text, most):
    """Words of the runs of neighbouring lines of fewer words, that have fewer together."""
    runs, held = [], []
    for line in [*(text or "").split("\n"), ""]:
        words = tuple(WORD.findall(low(line)))
        if 0 < len(words) < most:
            held += words
            continue
        if 0 < len(held) < most:
            runs.append(tuple(held))
        held = []
    return runs


@pytest.mark.parametrize("size", ["sf0.01", "made"])
def test_shorter_paragraphs_that_are_found_elsewhere_are_counted(spark, size):
    if size == "made":
        edge = prose(70, 49)
        rows = [(1, f"{edge}\n\n{prose(71, 60)}"), (2, f"{prose(72, 60)}\n{edge}"), (3, "Hello\n\nhello\n\nHELLO you"), (3, "Hello\n\nhello\n\nHELLO you"), (4, None), (5, f"{edge} more"), (None, "you"), (6, "\n\n")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
    else:
        df = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
        rows = [tuple(r) for r in df.collect()]
    places = defaultdict(set)
    for i, t in rows:
        for at, words in enumerate(short_paragraphs(t, 50)):
            places[words].add((i, t, at))
    want = {(i, t): sum(len(places[w]) > 1 for w in short_paragraphs(t, 50)) for i, t in rows}
    texts = df.select(F.col("doc_id").alias("id"), near_dup.document("doc_id", "text").alias("doc"), "text")
    got = texts.join(substring_dedup.short_repeats(texts, 50), "doc", "left").select("id", "text", F.coalesce("n_short", F.lit(0)).alias("n")).collect()
    assert {(r.id, r.text): r.n for r in got} == want and sum(want.values()) > 3
    if size == "made":
        assert {r.doc_id: r.n_short for r in substring_dedup.repeated(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0, None: 0}


def test_stretches_and_nodes_are_shuffled_once(docs, spark, monkeypatch):
    plans = {}

    def stored(df, name, *a):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().executedPlan().toString()
        return common.stored(df, name, *a)

    for module in (near_dup, substring_dedup):
        monkeypatch.setattr(module, "stored", stored)
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        substring_dedup.repeated(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(p.count("hashpartitioning(anchor") for p in plans.values()) == 1
    assert plans["nodes"].count("Exchange hashpartitioning") == 2  # the rows and the sums that they are joined with


@pytest.mark.parametrize("wide", [0, 64])
def test_only_what_was_counted_is_broadcast(spark, monkeypatch, wide):
    """Spark takes exploded band keys for a small table; sides that grow with the table are merged whatever their estimate."""
    plans, real = {}, common.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def stored(df, name, *a):
        plans[name] = plans.get(name, "") + plan(df)
        return real(df, name, *a)

    for module in (near_dup, common):
        monkeypatch.setattr(module, "stored", stored)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "WIDE", wide)
    monkeypatch.setattr(near_dup, "TASK_KEYS", 960)
    shared = prose(6, 100)
    rows = [(i, f"{shared} {prose(1000 + i // 2 if i % 10 < 2 else 2000 + i, 60)}") for i in range(60)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2)
    sent = {name for name, p in plans.items() if "Broadcast" in p}
    assert sent <= {"sets", "crowd", "rarer"}  # counted, or of buckets with thousands of members each
    assert "Broadcast" not in plan(got) and plans["stars"].count("SortMergeJoin") == 1 and plans["labels"].count("SortMergeJoin") >= 3
    assert re.search(r"hashpartitioning\(node#\d+L, 6\), REPARTITION_BY_NUM", plans["centres"])  # 54 nodes of 96 keys
    assert {r.doc_id: r.component_id for r in got.collect()} == brute({i: shingles(t, 2) for i, t in rows})
