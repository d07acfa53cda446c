"""Every core query against its SQL on the smallest driver tables, where these are at hand."""

import os
import subprocess
import sys

import pytest

from turnledger.plans import catalog

TABLES = "/root/testdata/sf0.001"


def test_queries_have_names_and_sql():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and set(catalog.QUERIES) - set(catalog.ORACLE) == {"sealed_files"}


def test_the_rest_does_not_need_the_corpus_operators():
    code = "import sys; sys.modules['turnledger.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables")
@pytest.mark.parametrize("name", ["history_check", "trace_rollup", "attribution", "collator_audit", "trainer_handoff", "paired_deltas", "p1_found", "p4_lineage"])
def test_query_equals_sql(spark, name):
    import duckdb

    import tools_compare as T

    db = duckdb.connect()
    for t in os.listdir(TABLES):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{t}'")
    df = catalog.QUERIES[name](spark, TABLES)
    rel = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in rel.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    want = sorted(tuple(T.normal(r[columns.index(c)]) for c in order) for r in rel.fetchall())
    assert sorted(tuple(T.normal(r[c]) for c in order) for r in df.collect()) == want
