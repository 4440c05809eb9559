"""Every query against its SQL on the smallest tables; every query has a stable schema."""

import os

import duckdb
import pytest

from corvale import store_queries  # noqa: F401 - it adds its queries to the others
from corvale.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_similarity_of_all_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = QUERIES["similarity_matrix_all"](spark, sf_dir)
    assert got.count() == e.where("vec_id % 50 = 0").count() * e.count()
    assert got.select("b_id").distinct().count() == e.select("vec_id").distinct().count()
