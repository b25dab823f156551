import hashlib
import re

from labframe.llm import decontamination

from .conftest import corpus, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(name) if name is not None else "null")
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    names |= windows[x]
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, prose(100, 120)[:300]), (10, "Short item HERE"), (2, "the the the the the the the the the the the"), (3, None), (4, "..."), (5, "never in any document at all"), (10, "Short item HERE"), (6, prose(500, 25)), (None, prose(501, 12))]


def planted():
    item = ITEMS[7][1]
    return [*corpus(), (900, "a short, item: here! and the the the the the the the the the the the the end"), (901, f"{prose(1, 30)} {item} {prose(2, 30)}"), (902, " ".join(item.split()[:9])), (903, " ".join(item.split()[3:14])), (904, f"{item} {item.upper()}"), (905, prose(501, 12))]


def test_hits_are_the_brute_force_ones(spark):
    docs = spark.createDataFrame([(*r, 1) for r in planted()], "doc_id bigint, text string, at int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.contamination(docs, items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(planted(), ITEMS)
    double = decontamination.contamination(docs.unionByName(docs), items).collect()
    assert sorted((r.doc_id, r.n_hit) for r in double) == sorted([(r.doc_id, r.n_hit) for r in got] * 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontamination.contamination(docs.where("doc_id < 0"), items).count() == 0
    assert not decontamination.contamination(docs, items.where("item_id < 0")).where("n_hit > 0").count()


def test_proximity_allows_a_slop(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, item), (2, item.replace("epsilon", "word epsilon other")), (3, "alpha " + "filler " * 30 + "kappa"), (4, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = {r.doc_id: (r.contaminated, r.n_near) for r in decontamination.contamination(docs, items, slop=5).collect()}
    assert rows[1] == (True, 1) and rows[2][0] is False and rows[2][1] == 1 and rows[4] == (False, 0)


def test_proximity_looks_past_terms_that_no_document_has(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota missing")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta eta theta iota too"), (2, "alpha"), (3, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_hit, r.n_near) for r in decontamination.contamination(docs, items, slop=5).collect()) == [(1, 0, 1), (2, 0, 0), (3, 0, 0)]


def test_an_index_of_all_tokens_serves_other_items(spark, tmp_path):
    spark.createDataFrame(planted(), "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = decontamination.postings(docs)
    for items in (ITEMS[:4], ITEMS[4:]):
        frame = spark.createDataFrame(items, "item_id bigint, text string")
        got = decontamination.contamination(docs, frame, index=index).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(planted(), items)


def test_no_python_runs_on_the_executors(spark):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string")
    plan = decontamination.contamination(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
