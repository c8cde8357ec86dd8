"""Every query of the engine against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from tablesmith.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, found.fetchall())


def test_flagship(spark, sf):
    assert {"column", "non_null", "distinct"} <= set(catalogue.flagship(spark, sf).columns)


def test_built_table_of_equal_metrics(spark, sf, duck, tmp_path):
    """In a large table every thing has the same greatest size and the same least price; the columns stay."""
    duck.sql(f"COPY (SELECT * REPLACE (50::INT AS p_size, 900.0::DOUBLE AS p_retailprice) FROM part) TO '{tmp_path}/part.parquet'")
    df = catalogue.queries()["built_table"](spark, str(tmp_path))
    sql = catalogue.oracle_sql()["built_table"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert df.columns == names
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_page_states_of_many_customers(spark, duck, tmp_path):
    """Pages of 3,200 lines: the query's rows are its SQL's, and its time doesn't grow with the square of a page's lines."""
    import time

    duck.sql(f"COPY (SELECT range AS c_custkey, (range % 25)::INT AS c_nationkey FROM range(80000)) TO '{tmp_path}/customer.parquet'")
    began = time.monotonic()
    df = catalogue.queries()["page_states"](spark, str(tmp_path))
    got = df.collect()
    took = time.monotonic() - began
    found = duck.execute(catalogue.oracle_sql()["page_states"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'"))
    names = [x[0] for x in found.description]
    assert rows(df.columns, got) == rows(names, found.fetchall()) and took < 60, took
