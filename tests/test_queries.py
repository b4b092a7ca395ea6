"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from cladewise.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return tuple(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    answer = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in at) for r in answer.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_truncate_to_documents_of_gaps(spark, tmp_path):
    """As in SQL where a text has gaps only, one at least or none."""
    texts = [" ", "a bcd", "É é.", "GATTACA", "1 2 3", "x", "", "ac gt", None, "tt", "  a b ", "ccgg aa", "   ", ""]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(catalog.ORACLES["truncate_to_query"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["truncate_to_query"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) and (2, "G") in got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
