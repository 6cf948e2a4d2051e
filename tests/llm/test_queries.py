"""Every registered training-data query on the smallest tables: against its SQL, or its rows."""

import os

import duckdb
import pytest

from sparsewing.llm import queries
from tests.test_queries import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
BASE = {"op9_source_mixing": "documents", "op2_lm_scoring": "documents", "op3_language_id": "documents", "op5_suffix_array_dedup": "documents", "op12_token_counts": "documents"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in db.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in db.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.oracle_sql())))
def test_a_row_for_each_row(spark, name):
    got = [r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/{BASE[name]}.parquet").collect())
