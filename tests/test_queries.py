"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from corpusmill.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


def test_split_filter_white_space(spark, tmp_path):
    """Line breaks at the ends of a cell are parts, and blanks of any width are not."""
    texts = {4: "Enon.\nAt", 9: "ab\u2003c\u00a0d", 14: "xe\tab\n", 19: "a\n\nab", 24: "\u3000 aab c", 29: "oa  bc"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["split_filter"](spark, str(tmp_path)).select("doc_id", "reason").collect()}
    assert got == set(con.execute(ORACLES["split_filter"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
