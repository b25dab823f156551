import random

import pytest

WORDS = [a + b + c for a in ("th", "on", "re", "ka", "mi") for b in ("an", "or", "él", "ing") for c in ("ed", "is", "o", "ation", "ß")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(text, seed, n):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, a very long text, odd spaces and signs."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One"), (6, "one"), (7, prose(7, 30_000)), (8, "a" * 3000 + " " + "1" * 500)]
    rows += [(9, "tab\tand  two spaces \n\n new   line　x 'll don't <|endoftext|> it's 😀 é é "), (10, "x  <|endoftext|> y <|endoftext|>")]
    base = [prose(100 + i, 120) for i in range(6)]
    rows += [(20 + i, b) for i, b in enumerate(base)] + [(40 + i, b) for i, b in enumerate(base[:3])]
    rows += [(100 + 10 * i + k, edited(b, 10 * i + k, 1 + 3 * k)) for i, b in enumerate(base) for k in range(6)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with further columns, some named as results or inner columns are."""
    rows = [(i, t, "en", i, 0.5, "s") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row bigint, score double, shard string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def twice(docs):
    """Every row two times, and one without a key."""
    return docs.unionByName(docs).unionByName(docs.where("doc_id = 20").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))
