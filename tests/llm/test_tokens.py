import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labframe.llm import byte_bpe, common, pieces, token_counts

from .conftest import corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_counts_are_the_librarys(docs):
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus()}
    got = token_counts.token_counts(docs, PATH).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH, batch_bytes=50).collect()} == {i: n for i, (_, n) in want.items()}


def test_counts_of_no_rows_and_repeated_rows(none, twice):
    assert token_counts.token_counts(none, PATH).count() == 0
    assert token_counts.token_counts(twice, PATH).where("n_tokens > 0").count() == 2 * (len(corpus()) - 2) + 1


def test_encoding_is_the_librarys_and_decodes(docs, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN)
    assert rows.columns == [*docs.columns, "ids"]
    rows = rows.withColumns({"bytes": byte_bpe.decoded(F.col("ids"), ranks), "sha": F.sha2(byte_bpe.little_endian(F.col("ids")), 256)}).collect()
    texts = dict(corpus())
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and bytes(r.bytes).decode() == (texts[r.doc_id] or "")
        assert r.sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_encoding_of_no_rows_and_clashing_names(none, twice, ranks, docs):
    assert byte_bpe.encoded(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encoded(twice, ranks, public_tokenizers.PATTERN).count() == 2 * len(corpus()) + 1
    again = byte_bpe.encoded(docs.withColumn("ids", F.lit(1)), ranks, public_tokenizers.PATTERN)
    assert again.columns == [*docs.columns, "ids"] and again.schema["ids"].dataType.simpleString() == "array<int>"


def test_texts_of_lines_without_spaces_are_cut():
    text = "\n".join(f"w{i}" for i in range(500)) + "\n\n end'll\t's\nlast"
    assert "".join(pieces.cut(text)) == text and max(map(len, pieces.cut(text))) < 20
    tokenizer = Tokenizer.from_file(PATH)
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert [i for p in pieces.cut(text) for i in tokenizer.encode(p, add_special_tokens=False).ids] == whole
    got = [(rows.tolist(), len(parts)) for rows, _, _, parts in pieces.distinct_parts(pa.array([text, "some plain words"]))]
    assert got[0] == ([1], 4) and got[1][0] == [0] and got[1][1] > 400


def test_batches_hold_equal_bytes():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes], pa.string())], ["t"]) for sizes in ([3, 4, 50], [], [1, 1, 1, 1], [9])]
    got = [b.column(0).to_pylist() for b in common.by_bytes(batches, "t", 10)]
    assert [[len(x) for x in b] for b in got] == [[3, 4], [50], [1, 1, 1, 1], [9]] and common.by_bytes([], "t", 10) is not None


def test_the_higher_order_fold_merges_as_the_batch_fold(spark, ranks):
    words = [b"hello", b" the", b"x", "straßenbahnhaltestelle".encode(), b"aaaaaaaaaa", b"internationalization", "\U0001f600".encode()]
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, w array<smallint>").coalesce(1)
    got = [r.ids for r in df.select("i", byte_bpe.merged(F.col("w"), ranks).alias("ids")).orderBy("i").collect()]
    ids, n = byte_bpe.all_merged(words, ranks)
    assert [x for g in got for x in g] == ids.tolist() and [len(g) for g in got] == n.tolist()
    assert [byte_bpe.by_heap(w, ranks) for w in words] == got
