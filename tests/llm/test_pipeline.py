import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from labframe.llm import byte_bpe, decontamination, near_dup, pii, queries, toxicity

from .conftest import edited, prose
from .test_decontamination import brute as contaminated
from .test_near_dup import brute as classes
from .test_near_dup import shingles


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontamination", "pii", "byte_bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_run_is_the_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r.doc_id: r.text for r in toxicity.without_toxic(docs, model).collect()}
    root = classes({i: shingles(t, near_dup.SHINGLE) for i, t in clean.items()})
    clean = {i: t for i, t in clean.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = contaminated(clean.items(), items)
    clean = {i: t for i, t in clean.items() if not hits[i][-1]}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert rows.keys() == clean.keys()
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in rows.items():
        assert r.ids == library.encode_ordinary(r.text) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
        assert r.text == clean[i] or pii.base_spans(clean[i])
    assert decontamination.WINDOW == 10 and docs.select(F.count("*")).first()[0] > len(rows)


def test_rows_are_dropped_by_row_and_not_by_key(spark, sf_dir):
    passage = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    a, b, c, d, e = (prose(200 + i, 80) for i in range(5))
    rows = [(1, a), (1, a), (None, a), (2, b), (2, edited(a, 1, 1)), (None, c), (None, edited(c, 1, 1)), (None, f"{d} {passage}"), (3, f"{e} {passage}"), (3, e + " clean")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted([(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf_dir).collect()], key=str)
    assert [t for i, t in kept if t == a] == [a] and (1, a) in kept and (2, b) in kept and len([t for _, t in kept if t in (rows[5][1], rows[6][1])]) == 1
    assert rows[4] not in kept and {rows[7], rows[8], rows[9]} <= set(kept) and len(kept) == 6
    left = corpus_pipeline.drop_contaminated(spark, df, sf_dir)
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=str) == sorted([r for r in rows if passage not in r[1]], key=str)


def test_stages_on_nulls_repeats_clashing_names_and_no_rows(spark, sf_dir, tmp_path):
    passage = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    rows = [(None, None, None), (None, None, None), (1, "", 0), (1, "", 0), (2, prose(300, 60), 1), (2, prose(300, 60), 1), (3, f"{prose(301, 20)} {passage}", None), (None, "write to a.b@mail.example.com", 3), (4, prose(302, 20_000), 9)]
    odd = ["ids", "n_tokens", "score", "row", "found", "spans", "component", "pipeline", "key", "label", "c0"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    for i, c in enumerate(odd):
        docs = docs.withColumn(c, F.lit(i))
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, before.where("false"), sf_dir).count() == 0
        docs = stage(spark, before, sf_dir)
        assert set(docs.columns) == set(before.columns)
        docs = docs.persist()
        texts = [r.text for r in docs.collect()]
        if name == "near_dup":
            assert len(texts) == 8 and texts.count(rows[4][1]) == 1
        if name == "decontamination":
            assert len(texts) == 7 and not any(passage in (t or "") for t in texts)
        if name == "pii":
            assert "write to <EMAIL>" in texts and {r.n_chars for r in docs.where("text IS NULL").collect()} == {None}
    got = {r.text: (r.ids, r.n_tokens) for r in docs.collect()}
    assert got[None] == ([], 0) == got[""] and got[rows[8][1]][1] > 20_000
