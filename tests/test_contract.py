"""The driver contract: every query runs, has the columns of its SQL, and gives the same rows at the smallest scale."""

import math
import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

from folianth import queries  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "author" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_books_are_all_parts(spark, tmp_path):
    spark.createDataFrame([(i, f"ann lee {i}", "BRASS", "Brand#1") for i in (1, 2)], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "a text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.snippet for r in queries.books(spark, str(tmp_path)).collect()} == {"a text", None}
    assert queries.decided_titles(spark, str(tmp_path)).count() == 2


def test_library_prior_deals_out_no_pairs_of_document_and_word(spark, tmp_path):
    rows = [(1, "Ana ana LEE"), (2, "ana"), (2, "ana bo"), (2, None), (3, "ana lee"), (None, "lee"), (None, "lee bo"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.library_prior(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("ana", 3), ("lee", 3)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan and "hashpartitioning(shared" in plan
