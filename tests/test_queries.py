"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from lectern.plans import aggregates, banks, formats, ingest, matching, parsing, scalars  # noqa: F401
from lectern.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([tuple(r)[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = df.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, found) == rows(want.columns, want.fetchall())
    else:
        assert found


def test_odd_texts_in_four_encodings(spark, duck, tmp_path):
    odd = [None, "", "\ufeffmarked", '<?xml version="1.0" encoding="latin-1"?><a>é</a>', "Das\nist für Sie\n" * 9, "� \ue123", "한국어 텍스트"]
    ids = [k + 4 * len(odd) * j for j, _ in enumerate(odd) for k in range(4)] + [None, 2**53 + 1]
    table = [(i, odd[k // 4 % len(odd)]) for k, i in enumerate(ids)]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df, con = QUERIES["src_text_auto"](spark, str(tmp_path)), duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(SQL["src_text_auto"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
