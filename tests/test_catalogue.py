"""Each core query with SQL gives the same rows as DuckDB over the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from fundstelle import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float | decimal.Decimal):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalogue.ORACLE:
        return
    found = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    wanted = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)


def test_context_of_every_chunk(spark):
    """Each chunk has its row, not only those at the start of a document."""
    found = {r.id: r for r in catalogue.QUERIES["chunk_context_all"](spark, FOLDER).collect()}
    ids = {r.id for r in spark.read.parquet(f"{FOLDER}/chunks.parquet").filter("id IS NOT NULL").collect()}
    assert set(found) == ids and sum(r.n_before > 0 for r in found.values()) > len(ids) / 2


def test_entry(spark):
    assert catalogue.flagship(spark, FOLDER).count() > 0


def test_sections_by_id_shuffle_no_pairs(spark):
    found = catalogue.QUERIES["fts_all_by_id"](spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
