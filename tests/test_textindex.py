"""The trigram index against LIKE on every row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labframe.operators import search, textindex
from labframe.sources.io import stored

ROWS = [(1, "abcabcabd", "x"), (2, "aaaa", None), (3, None, None), (4, "", "é日本語é"), (5, "a\\b%c_d", "abc"), (6, "ab", "bc"), (7, "xxabcyyabd", "abd abc"), (8, "ABC", "line\nbreak abc")]
TERMS = ["abc", "abc%abd", "abd%abc", "aaa", "a_c", "ab_abc", "日本語", "日_語", "\\b%", "%", "", "b", "bca", "c_d", "abc_bd", "nope", "abcabcabd", "k a", "cab%ca", "___d", "ABC"]


def like(value, q):
    return value is not None and re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q), value, re.S) is not None


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    more = [(10 + i, "".join(r.choice("abc_") for _ in range(r.randrange(12))), "".join(r.choice("abcd") for _ in range(r.randrange(6)))) for i in range(300)]
    return spark.createDataFrame(ROWS + more, "id bigint, name string, code string"), ROWS + more


def test_indexed_matches_are_those_of_a_scan(spark, table):
    df, rows = table
    index = stored(textindex.text_index(df, ["name", "code"]), "index")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "term_id int, q string")
    got = sorted(map(tuple, textindex.matches(df, index, terms, ["name", "code"]).collect()))
    assert got == sorted((i, row[0]) for i, q in enumerate(TERMS) for row in rows if like(row[1], q) or like(row[2], q))
    only = sorted(map(tuple, textindex.matches(df, index, terms, ["code"]).collect()))
    assert only == sorted((i, row[0]) for i, q in enumerate(TERMS) for row in rows if like(row[2], q))
    few = df.where("id < 5")
    assert {x.id for x in textindex.matches(few, index, terms, ["name"]).collect()} <= {1, 2, 4}
    assert textindex.matches(df, index, terms.where("false"), ["name"]).count() == 0


def test_plans_have_no_nested_loop(spark, table):
    df, _ = table
    terms = spark.createDataFrame([(1, "abc"), (2, "abc%_bd"), (3, "a_bca")], "term_id int, q string")
    plan = textindex.matches(df, stored(textindex.text_index(df, ["name"]), "index"), terms, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    best = search.top_of_terms(df, terms, ["name", "code"], search.keys("name"), 2)
    assert "NestedLoop" not in best._jdf.queryExecution().executedPlan().toString() and best.groupBy("term_id").count().where("count > 2").count() == 0


def test_no_side_that_grows_is_broadcast(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("a"))
    index = stored(textindex.text_index(rows, ["a"]), "index")
    terms = spark.createDataFrame([(1, "#0%12"), (2, "0000"), (3, "99")], "term_id int, q string")
    found = textindex.matches(rows, index, terms, ["a"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert dict(found.groupBy("term_id").count().collect()) == {1: sum("12" in f"{i:09d}" for i in range(2000)), 2: 2000, 3: sum("99" in f"{i:09d}" for i in range(2000))}
