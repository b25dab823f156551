"""Every query of the lab operators against its SQL twin."""

import math

import duckdb
import pandas as pd
import pytest

from labframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", ["detail_insert", "detail_insert_faults", "detail_insert_chains"])
def test_batches_of_details_beyond_a_million_ids(spark, duck, sf_dir, tmp_path, name):
    part = f"SELECT * REPLACE (p_partkey + k * 500000 AS p_partkey) FROM '{sf_dir}/part.parquet', range(4) r(k)"
    duck.sql(f"COPY ({part}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    if name == "detail_insert":
        assert got.id.is_unique
