"""Every prose query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from prosegrain.config import Config
from prosegrain.operators import rules
from prosegrain.operators.scopes import scopes
from prosegrain.plans import catalog

TABLES = "documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    rows, sql = got.collect(), catalog.oracle_sql().get(name)
    assert rows
    if sql:
        want = duck.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert plain(map(tuple, rows)) == plain(want)


def test_scopes_are_made_without_a_shuffle_and_read_two_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("file", F.col("doc_id").cast("string"))
    plan = rules.sentence_length(scopes(docs), Config())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("SPARK_PARTITION_ID") == 1  # the scope is computed once


def test_entry_works(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["file", "line", "value", "word"]
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
